"""Imports every query module, which fills the registry."""

from checks import q_deals, q_ingest, q_resolve, q_run, q_text  # noqa: F401
from checks.registry import ORACLES, QUERIES  # noqa: F401

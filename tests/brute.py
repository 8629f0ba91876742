"""Plain-Python statements of the rules, for small fixtures."""

from __future__ import annotations

import re

from newsfunnel import dims


def groups(nodes, edges):
    """{node: smallest node of its component} by union-find."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def norm_title(s):
    return " ".join(sorted(re.findall("[a-z0-9]+", s.lower())))


def title_ratio(a, b):
    a, b = norm_title(a), norm_title(b)
    longest = max(len(a), len(b))
    if not longest:
        return 100
    return int((1 - levenshtein(a, b) / longest) * 100 + 0.5)


def distinctive(s):
    return {t for t in re.findall("[a-z0-9]+", s.lower())
            if len(t) > 1 and t not in dims.GENERIC_TOKENS}


def values_equal(x, y):
    if x["deal_value"] is None or y["deal_value"] is None or x["currency"] != y["currency"]:
        return False
    gap = abs(x["deal_value"] - y["deal_value"])
    return gap <= 0.01 * max(x["deal_value"], y["deal_value"])


def same_deal(x, y):
    if x["deal_type"] != y["deal_type"]:
        return False
    if abs((x["announced_date"] - y["announced_date"]).total_seconds()) > 5 * 86400:
        return False
    if not distinctive(x["target"]) & distinctive(y["target"]):
        return False
    hidden = [d["acquirer"].strip().lower() in ("", "undisclosed") for d in (x, y)]
    if not any(hidden):
        both = x["deal_value"] is not None and y["deal_value"] is not None
        return bool(distinctive(x["acquirer"]) & distinctive(y["acquirer"])) and not (
            both and not values_equal(x, y))
    stake = x["stake_pct"] is not None and x["stake_pct"] == y["stake_pct"]
    return values_equal(x, y) or stake

"""The declared schema of landed feed items, as DDL."""

from __future__ import annotations

# A feed item as landed; `source` takes the element text with or without attributes.
FEED_ITEM = (
    "title string, link string, isoDate string, pubDate string, contentSnippet string, "
    "content string, source string, _corrupt_record string"
)


def names(ddl: str) -> list[str]:
    return [column.split()[0] for column in ddl.split(",")]

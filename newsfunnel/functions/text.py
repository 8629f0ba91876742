"""Text expressions: HTML stripping, titles, name tokens, prompt lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsfunnel import dims

# Whitespace as web text uses it: ASCII blanks, NBSP, the Unicode spaces and the BOM. Java's
# own \s is ASCII only, so the class is spelled out.
WEB_SPACE = (
    "[\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
)

_ENTITIES = [
    ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&quot;", '"'), ("(?i)&#39;|&apos;", "'"),
    ("(?i)&lt;", "<"), ("(?i)&gt;", ">"),
]


def web_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WEB_SPACE}+|{WEB_SPACE}+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(web_trim(c), F.lit(""))


def strip_html(c: Column) -> Column:
    """Plain text of an HTML fragment.

    Tags go before entities are decoded and `&amp;` is decoded first, so `&amp;lt;` ends as
    `<` and an escaped tag survives as text.
    """
    c = F.regexp_replace(c, r"(?is)<script.*?</script>", " ")
    c = F.regexp_replace(c, r"(?is)<style.*?</style>", " ")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    for entity, char in _ENTITIES:
        c = F.regexp_replace(c, entity, char)
    # A plain space alone is left as it is: most runs are that.
    return F.trim(F.regexp_replace(c, f"{WEB_SPACE}{{2,}}|{WEB_SPACE.replace(' ', '', 1)}", " "))


def html_title(html: Column) -> Column:
    return strip_html(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def headline(text: Column) -> Column:
    """First line of a text: its headline."""
    return F.substring_index(text, "\n", 1)


def after_headline(text: Column) -> Column:
    """Everything after the headline; '' for one-line texts."""
    return F.regexp_replace(text, r"^[^\n]*\n?", "")


def name_tokens(c: Column) -> Column:
    """Lower-cased ASCII alphanumeric runs, in order."""
    return F.array_remove(F.split(F.lower(c), "[^a-z0-9]+"), "")


def normalize_title(c: Column) -> Column:
    """Tokens of a title, sorted, so word order stops mattering."""
    return F.array_join(F.sort_array(name_tokens(c)), " ")


def ratio_permille(min_ratio: int) -> int:
    """Edit budget per 1000 characters below which `title_ratio` rounds to >= min_ratio."""
    return 1005 - 10 * min_ratio


def title_ratio(norm_a: Column, norm_b: Column) -> Column:
    """0..100 similarity of two normalised titles; two empty ones count as equal."""
    longest = F.greatest(F.length(norm_a), F.length(norm_b))
    share = F.lit(1.0) - F.levenshtein(norm_a, norm_b) / F.nullif(longest, F.lit(0))
    return F.when(longest == 0, F.lit(100)).otherwise(
        F.floor(share * 100 + 0.5).cast("int")
    )


def token_sort_ratio(a: Column, b: Column) -> Column:
    return title_ratio(normalize_title(a), normalize_title(b))


def distinctive_tokens(c: Column, generic: list[str] = dims.GENERIC_TOKENS) -> Column:
    """Tokens that carry identity: two characters or more and not a generic word."""
    return F.filter(name_tokens(c), lambda t: (F.length(t) >= 2) & ~t.isin(generic))


def names_an_entity(c: Column, generic: list[str] = dims.GENERIC_TOKENS) -> Column:
    return F.size(distinctive_tokens(c, generic)) > 0


def shares_distinctive_token(
    a: Column, b: Column, generic: list[str] = dims.GENERIC_TOKENS
) -> Column:
    return F.arrays_overlap(distinctive_tokens(a, generic), distinctive_tokens(b, generic))


def embed_text(title: Column, snippet: Column) -> Column:
    """The text handed to an embedder, cut at its input limit."""
    return F.substring(F.concat(title, F.lit(". "), snippet), 1, dims.EMBED_TEXT_LENGTH)


def title_line(n: Column, title: Column) -> Column:
    return F.concat(n.cast("string"), F.lit(". "), title)


def article_lines(n: Column, title: Column, source: Column, snippet: Column) -> Column:
    return F.concat(
        n.cast("string"), F.lit(". Title: "), title,
        F.lit("\n   Source: "), source,
        F.lit("\n   Snippet: "), F.substring(snippet, 1, dims.PROMPT_SNIPPET_LENGTH),
    )


def extract_prompt(title: Column, source: Column, published: Column, snippet: Column) -> Column:
    return F.concat(
        F.lit("Title: "), title, F.lit("\nSource: "), source,
        F.lit("\nDate: "), F.date_format(published, "yyyy-MM-dd"),
        F.lit("\nSnippet: "), F.substring(snippet, 1, dims.EXTRACT_SNIPPET_LENGTH),
    )

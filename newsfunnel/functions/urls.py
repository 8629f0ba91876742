"""URL expressions. The generic-URI regular expression splits without ever raising, which
`parse_url` does under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsfunnel import dims
from newsfunnel.functions.text import web_trim

# scheme, user info, host, port, path, query
_URI = (
    r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#:@]+)(?::([0-9]*))?"
    r"([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
)


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URI, group)


def is_parseable(url: Column) -> Column:
    return url.rlike(_URI)


def host(url: Column) -> Column:
    """Lower-cased host without `www.`; '' when there is none."""
    return F.regexp_replace(F.lower(_part(url, 3)), r"^www\.", "")


def source_from_url(url: Column) -> Column:
    return F.when(is_parseable(url), host(url)).otherwise(F.lit("Unknown"))


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _param_name(param: Column) -> Column:
    return _decoded(F.substring_index(param, "=", 1))


def query_params(url: Column) -> Column:
    return F.filter(F.split(_part(url, 6), "&"), lambda p: p != "")


def _with(value: Column, build) -> Column:
    """`build(value)` with `value` computed once, however often `build` uses it."""
    return F.element_at(F.transform(F.array(value), build), 1)


def _carried_url(url: Column) -> Column:
    """The `url` parameter of a news wrapper, NULL for any other URL."""
    carried = F.filter(query_params(url), lambda p: _param_name(p) == "url")
    target = _decoded(F.regexp_replace(F.try_element_at(carried, F.lit(1)), "^[^=]*=?", ""))
    return F.when(F.lower(_part(url, 3)).endswith(dims.WRAPPER_HOST_SUFFIX), target)


def unwrap(url: Column) -> Column:
    """The publisher URL carried in a news wrapper's `url` parameter, else the URL itself."""
    return _with(_carried_url(url), lambda t: F.when(is_parseable(t), t).otherwise(url))


def _kept_query(query: Column, tracking: str) -> Column:
    """The query without tracking parameters, ordered by parameter name and then position."""
    params = F.filter(F.split(query, "&"), lambda p: p != "")
    named = F.transform(
        params, lambda p, i: F.struct(_param_name(p).alias("k"), i.alias("i"), p.alias("p"))
    )
    kept = F.filter(named, lambda s: ~F.lower(s["k"]).rlike(tracking))
    return F.array_join(F.transform(F.sort_array(kept), lambda s: s["p"]), "&")


def _rebuild(parts: Column, tracking: str) -> Column:
    scheme, user, name, port = (F.element_at(parts, i) for i in (1, 2, 3, 4))
    path, query = F.element_at(parts, 5), F.element_at(parts, 6)
    default_port = F.concat(F.lower(scheme), F.lit(":"), port).isin("http:80", "https:443")
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))

    def unless_empty(c: Column, before: str, after: str = "") -> Column:
        return F.when(c == "", F.lit("")).otherwise(F.concat(F.lit(before), c, F.lit(after)))

    return F.concat(
        F.lower(scheme), F.lit("://"), unless_empty(user, "", "@"),
        F.regexp_replace(F.lower(name), r"^www\.", ""),
        F.when(default_port, F.lit("")).otherwise(unless_empty(port, ":")),
        F.when(path == "", F.lit("/")).otherwise(path),
        _with(_kept_query(query, tracking), lambda q: unless_empty(q, "?")),
    )


def canonicalize_url(raw: Column, tracking: str = dims.TRACKING_PARAM) -> Column:
    """One spelling per document: wrapper opened, tracking parameters dropped, scheme and host
    lower-cased, `www.`, default port, fragment and trailing slashes removed, parameters
    sorted by name (stable). A URL that does not parse comes back trimmed."""

    def parts(url: Column) -> Column:
        return F.array(*[_part(url, i) for i in range(1, 7)])

    def rebuilt(url: Column) -> Column:
        whole = _with(unwrap(url), lambda u: _with(parts(u), lambda p: _rebuild(p, tracking)))
        return F.when(is_parseable(url), whole).otherwise(url)

    return _with(web_trim(raw), rebuilt)


def article_id(url: Column) -> Column:
    """Stable key of a document: first 12 hex digits of the URL's SHA-1."""
    return F.substring(F.sha1(url), 1, 12)


def encode_component(c: Column) -> Column:
    """Percent-encoding for a query value: blanks as %20, and ! ~ ' ( ) left bare."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, char in [("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")]:
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def search_url(query: Column) -> Column:
    return F.concat(
        F.lit(dims.SEARCH_URL_PREFIX), encode_component(query), F.lit(dims.SEARCH_URL_SUFFIX)
    )

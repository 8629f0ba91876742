"""SQL twins of checks/views.py and SQL spellings of the expressions under test."""

from __future__ import annotations

from newsfunnel import dims
from newsfunnel.functions.text import WEB_SPACE

from checks import views


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def values_cte(name: str, columns: str, rows) -> str:
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def sub(c: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({c}, {lit(pattern)}, {lit(to)}, 'g')"


def web_trim(c: str) -> str:
    return sub(c, f"^{WEB_SPACE}+|{WEB_SPACE}+$")


def strip_html(c: str) -> str:
    for pattern, to in [
        (r"(?is)<script.*?</script>", " "), (r"(?is)<style.*?</style>", " "), ("<[^>]+>", " "),
        ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&quot;", '"'),
        ("(?i)&#39;|&apos;", "'"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"),
        (f"{WEB_SPACE}+", " "),
    ]:
        c = sub(c, pattern, to)
    return f"trim({c})"


def html_title(c: str) -> str:
    return strip_html(f"regexp_extract({c}, '(?is)<title[^>]*>(.*?)</title>', 1)")


def tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[a-z0-9]+')"


def norm_title(c: str) -> str:
    return f"coalesce(array_to_string(list_sort({tokens(c)}), ' '), '')"


def distinctive(c: str) -> str:
    return (
        f"list_filter({tokens(c)}, lambda t: length(t) >= 2 AND t NOT IN "
        f"{in_list(dims.GENERIC_TOKENS)})"
    )


def title_ratio(a: str, b: str) -> str:
    longest = f"greatest(length({a}), length({b}))"
    return (
        f"CASE WHEN {longest} = 0 THEN 100 ELSE "
        f"CAST(floor((1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / {longest}) * 100 + 0.5) "
        "AS INTEGER) END"
    )


URI = (
    r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#:@]+)(?::([0-9]*))?"
    r"([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
)


def uri(c: str, part: int) -> str:
    return f"regexp_extract({c}, {lit(URI)}, {part})"


def host(c: str) -> str:
    return sub(f"lower({uri(c, 3)})", r"^www\.")


def canonical_url(c: str) -> str:
    c = web_trim(c)
    params = f"list_filter(string_split({uri(c, 6)}, '&'), lambda p: p <> '')"
    keyed = (
        f"list_transform({params}, lambda p, i: "
        "{'k': url_decode(split_part(p, '=', 1)), 'i': i, 'p': p})"
    )
    kept = (
        f"list_filter({keyed}, lambda s: NOT regexp_matches(lower(s.k), "
        f"{lit(dims.TRACKING_PARAM)}))"
    )
    query = f"array_to_string(list_transform(list_sort({kept}), lambda s: s.p), '&')"
    path = f"CASE WHEN {uri(c, 5)} IN ('', '/') THEN '/' ELSE {sub(uri(c, 5), '/+$')} END"
    return (
        f"CASE WHEN regexp_matches({c}, {lit(URI)}) THEN lower({uri(c, 1)}) || '://' || {host(c)}"
        f" || CASE WHEN {uri(c, 4)} = '' THEN '' ELSE ':' || {uri(c, 4)} END"
        f" || {path} || CASE WHEN coalesce({query}, '') = '' THEN '' ELSE '?' || {query} END"
        f" ELSE {c} END"
    )


def article_id(c: str) -> str:
    return f"left(sha1({c}), 12)"


def doc_key(c: str = "doc_id") -> str:
    return f"'a' || lpad(CAST({c} AS VARCHAR), 10, '0')"


def deal_key(c: str) -> str:
    return f"'d' || lpad(CAST({c} AS VARCHAR), 10, '0')"


def usd(value: str = "deal_value", currency: str = "currency") -> str:
    return (
        f"CASE {currency} WHEN 'INR_CRORE' THEN {value} * 0.12::DOUBLE WHEN 'USD_MILLION' THEN "
        f"{value} WHEN 'INR' THEN {value} / 8300000.0::DOUBLE WHEN 'USD' THEN "
        f"{value} / 1000000.0::DOUBLE END"
    )


def size_score() -> str:
    u = usd()
    return (
        f"CASE WHEN {u} IS NULL THEN 0.5 WHEN {u} >= 500 THEN 1.0 WHEN {u} >= 100 THEN 0.85 "
        f"WHEN {u} >= 25 THEN 0.7 WHEN {u} >= 5 THEN 0.5 ELSE 0.35 END::DOUBLE"
    )


def recency(ts: str, now: str, days: int) -> str:
    age = f"(epoch_us(TIMESTAMP '{now}') - epoch_us({ts}))::DOUBLE / 86400000000.0"
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - {age} / {days}))"


def badge(c: str) -> str:
    return f"CASE WHEN {c} >= 0.75 THEN 'High' WHEN {c} >= 0.45 THEN 'Med' ELSE 'Low' END"


def format_value(value: str = "deal_value", currency: str = "currency") -> str:
    t = f"CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(30,8)), 3) AS VARCHAR)"
    whole = f"split_part({t}, '.', 1)"
    frac = f"rtrim(split_part({t}, '.', 2), '0')"
    head = f"reverse(left({whole}, length({whole}) - 3))"
    pairs = f"ltrim(reverse(regexp_replace({head}, '([0-9][0-9])', '\\1,', 'g')), ',')"
    grouped = (
        f"CASE WHEN length({whole}) <= 3 THEN {whole} ELSE {pairs} || ',' || right({whole}, 3) END"
    )
    n = f"({grouped} || CASE WHEN {frac} = '' THEN '' ELSE '.' || {frac} END)"
    return (
        f"CASE WHEN {value} IS NULL THEN 'Undisclosed' WHEN {currency} = 'INR_CRORE' THEN "
        f"'₹' || {n} || ' cr' WHEN {currency} = 'USD_MILLION' THEN '$' || {n} || ' mn' "
        f"WHEN {currency} = 'INR' THEN '₹' || {n} WHEN {currency} = 'USD' THEN '$' || {n} "
        f"WHEN coalesce({currency}, '') = '' THEN {n} ELSE {n} || ' ' || {currency} END"
    )


def plain_number(c: str) -> str:
    return (
        f"coalesce(CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS DECIMAL(20,0)) AS VARCHAR) "
        f"ELSE CAST({c} AS VARCHAR) END, '')"
    )


NOW = views.NOW.strftime("%Y-%m-%d %H:%M:%S")
EVENTS_NOW = views.EVENTS_NOW.strftime("%Y-%m-%d %H:%M:%S")

CTES: dict[str, tuple[list[str], str]] = {
    "articles_v": ([], f"""
        SELECT {article_id(canonical_url('raw_url'))} AS id, {html_title('html')} AS title,
          raw_url AS url, h AS source,
          CASE WHEN h LIKE '%.com' THEN 1 WHEN h LIKE '%.net' THEN 2 ELSE 3 END AS source_tier,
          TIMESTAMP '2024-01-01' + to_hours(CAST(page_id + copy AS INTEGER)) AS published_at,
          {strip_html('html')} AS snippet, h AS query_term,
          page_id + copy * 1000000000 AS feed_pos
        FROM (SELECT *, {host('url')} AS h, CASE WHEN copy = 0 THEN url ELSE
            split_part(url, '#', 1) || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END
            || 'utm_campaign=x' || regexp_extract(url, '#.*$') END AS raw_url
          FROM pages, (VALUES (0), (1)) c(copy))"""),
    "doc_articles_v": ([], f"""
        SELECT {doc_key()} AS id, doc_id, split_part(text, chr(10), 1) AS title,
          'doc:' || doc_id AS url, source, 3 AS source_tier,
          TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INTEGER)) AS published_at,
          CASE WHEN contains(text, chr(10)) THEN substring(text, instr(text, chr(10)) + 1)
            ELSE '' END AS snippet,
          source AS query_term, doc_id AS feed_pos
        FROM documents"""),
    "deals_v": ([], f"""
        SELECT {deal_key('o_orderkey')} AS deal_id, {deal_key('o_orderkey')} AS cluster_id,
          CASE WHEN o_custkey % 7 = 0 THEN 'Undisclosed'
            ELSE replace(c_name, 'Customer#', 'C') END AS acquirer,
          p_name AS target,
          CASE left(o_orderpriority, 1) WHEN '2' THEN 'Funding' WHEN '3' THEN 'Stake'
            WHEN '4' THEN 'JV' ELSE 'M&A' END AS deal_type,
          CASE o_orderkey % 5 WHEN 0 THEN o_totalprice / 1000 WHEN 1 THEN o_totalprice / 1000
            WHEN 2 THEN o_totalprice * 10000 WHEN 3 THEN o_totalprice * 1000 END AS deal_value,
          CASE o_orderkey % 5 WHEN 0 THEN 'INR_CRORE' WHEN 1 THEN 'USD_MILLION' WHEN 2 THEN 'INR'
            WHEN 3 THEN 'USD' END AS currency,
          CASE WHEN o_orderkey % 3 = 0 THEN qty END AS stake_pct,
          c_mktsegment AS category, r_name AS region, o_orderdate AS announced_date,
          (o_orderkey % 101)::DOUBLE / 100 AS relevance_conf, o_orderkey AS feed_pos
        FROM orders
        JOIN (SELECT l_orderkey, min(l_partkey) AS pk, min(l_quantity) AS qty
              FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
        JOIN part ON p_partkey = pk JOIN customer ON c_custkey = o_custkey
        JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"""),
    "evidence_v": ([], f"""
        SELECT DISTINCT {deal_key('l_orderkey')} AS deal_id,
          {deal_key('l_orderkey')} || '-' || l_suppkey AS article_id, s_name AS source,
          CAST(l_suppkey % 3 + 1 AS INTEGER) AS source_tier
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey"""),
    "deals_rated_v": (["deals_v", "evidence_v"], """
        SELECT d.*, coalesce(n, 0) AS n_sources, sources,
          least(CASE coalesce(t, 3) WHEN 1 THEN 0.75 WHEN 2 THEN 0.5 ELSE 0.25 END::DOUBLE
            + least(greatest(coalesce(n, 0) - 1, 0) * 0.12::DOUBLE, 0.25::DOUBLE),
            1.0::DOUBLE) AS credibility_score
        FROM deals_v d LEFT JOIN (
          SELECT deal_id, count(DISTINCT source) AS n, min(source_tier) AS t,
            list_sort(list(DISTINCT source)) AS sources
          FROM evidence_v GROUP BY 1) USING (deal_id)"""),
    "deals_scored_v": (["deals_rated_v"], f"""
        SELECT *, {badge('credibility_score')} AS confidence,
          0.35::DOUBLE * relevance_conf + 0.3::DOUBLE * credibility_score
          + 0.2::DOUBLE * {recency('announced_date', NOW, views.WINDOW)}
          + 0.15::DOUBLE * {size_score()} AS score
        FROM deals_rated_v"""),
    "selected_v": (["deals_scored_v"], """
        SELECT *, row_number() OVER (ORDER BY score DESC, feed_pos, deal_id) AS rank_pos
        FROM deals_scored_v ORDER BY score DESC, feed_pos, deal_id LIMIT 12"""),
    "verdicts_v": ([], f"""
        SELECT {doc_key()} AS id, quality = 1 AS is_deal, toxic = 0 AS screen FROM labels"""),
}


def with_views(*names: str, body: str, extra: list[str] = (), recursive: bool = False) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order] + list(extra)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" if parts else "") + body


def components(nodes: str, edges: str, name: str = "") -> list[str]:
    """CTEs comp(node, component): transitive closure of edges(a, b) from every node; their names
    begin with `name`."""
    return [
        f"{name}sym AS (SELECT a, b FROM ({edges}) UNION SELECT b, a FROM ({edges}))",
        f"{name}reach(node, other) AS (SELECT n, n FROM ({nodes}) t(n) UNION "
        f"SELECT r.node, s.b FROM {name}reach r JOIN {name}sym s ON s.a = r.other)",
        f"{name}comp AS (SELECT node, min(other) AS component FROM {name}reach GROUP BY node)",
    ]

"""URL filters with a Bloom filter cascade, built and used by DataFrame functions only.

Level 1 encodes the listed keys; level 2 the false positives of level 1 over all keys that occur
in the corpus; level 3 the listed keys that level 2 takes for false positives; and so on until a
level makes no mistake. For every key of the corpus the cascade then answers exactly, with bit
tests on constants and no join.

Keys are host suffix + path prefix. Only suffixes with as many labels and prefixes as long as some
listed key are keys at all, so a URL has few.

Filters become constants of the plan, so their size is checked: a list that needs more than
`max_bits` is looked up with a join instead.

Defined results: a null URL or one without "://" has empty host and path and fits no rule;
repeated rows are judged one by one; an empty table gives no rows; extra columns are ignored.
A URL that no rule fits is allowed: it is in none of the lists.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsfunnel.llm.textkit import stage, table

MAX_BITS = 1 << 23
BLOCK = ("net/", "example.com/de/")
ALLOW = ("example.net/en/", "org/fr/")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Level:
    bits: int
    hashes: int
    seed: int
    words: str  # 64 bits each, comma-separated: one foldable constant

    def has(self, key: Column) -> Column:
        words = F.split(F.lit(self.words), ",").cast("array<long>")
        test = F.lit(True)
        for place in _places(key, self.bits, self.hashes, self.seed):
            word = F.element_at(words, (F.shiftright(place, 6) + 1).cast("int"))
            test = test & (F.getbit(word, place.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return test


def _places(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    """Double hashing: two 64-bit hashes give all positions."""
    a, b = F.xxhash64(key, F.lit(seed)), F.xxhash64(F.lit(seed), key)
    return [F.pmod(a + F.lit(i) * F.pmod(b, F.lit(1 << 31)), F.lit(bits)) for i in range(hashes)]


def _level(keys: DataFrame, count: int, rate: float, seed: int) -> Level:
    hashes = max(1, round(math.log2(1 / rate)))
    bits = max(64, math.ceil(count * math.log2(1 / rate) / math.log(2) / 64) * 64)
    place = F.explode(F.array(*_places(F.col("key"), bits, hashes, seed))).alias("place")
    set_words = (
        keys.select(place).groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("mask")).collect()
    )  # at most bits / 64 rows
    words = [0] * (bits // 64)
    for r in set_words:
        words[r["word"]] = r["mask"]
    return Level(bits, hashes, seed, ",".join(map(str, words)))


@dataclass
class Cascade:
    levels: list[Level]

    def has(self, key: Column) -> Column:
        if not self.levels:
            return F.lit(False)
        test = None
        for i in range(len(self.levels) - 1, -1, -1):
            inside = self.levels[i].has(key)
            if i % 2 == 0:
                test = inside if test is None else inside & test
            else:
                test = ~inside if test is None else ~inside | test
        return test


def build_cascade(listed: DataFrame, universe: DataFrame, max_bits: int = MAX_BITS) -> Cascade | None:
    """Exact for every key of `universe` (both have one column, key). None: too large."""
    listed = stage(listed.distinct(), "listed")
    others = stage(universe.join(listed, "key", "left_anti").distinct(), "others")
    n, u = listed.count(), others.count()
    levels: list[Level] = []
    if n == 0:
        return Cascade(levels)
    rate = min(0.5, max(n / max(u, 1) * math.sqrt(0.5), 1e-12))
    encoded, tested, count = listed, others, n
    while True:
        if count * math.log2(1 / rate) / math.log(2) > max_bits:
            return None
        levels.append(_level(encoded, count, rate, seed=len(levels) + 1))
        wrong = stage(tested.filter(levels[-1].has(F.col("key"))), "wrong")
        count = wrong.count()
        if count == 0:
            return Cascade(levels)
        encoded, tested, rate = wrong, encoded, 0.5


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) as the rules see them."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _shape(rules: list[str]) -> tuple[int, list[int]]:
    """Most labels of a listed host, and all lengths of listed paths."""
    hosts = [r.partition("/")[0] for r in rules]
    return max((h.count(".") + 1 for h in hosts), default=1), sorted({len(r) - len(h) for r, h in zip(rules, hosts)})


def url_keys(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    parts = F.split(host, r"\.")
    count = F.least(F.size(parts), F.lit(labels))
    suffixes = F.transform(
        F.sequence(F.lit(1), count),
        lambda i: F.array_join(F.slice(parts, F.size(parts) - i + 1, i), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    return F.flatten(F.transform(
        suffixes, lambda s: F.transform(fitting, lambda n: F.concat(s, F.substring(path, F.lit(1), n)))))


def filter_urls(pages: DataFrame, block: tuple[str, ...] = BLOCK, allow: tuple[str, ...] = ALLOW,
                max_bits: int = MAX_BITS) -> DataFrame:
    """page_id, host, path, rule (the longest that fits), verdict."""
    spark = pages.sparkSession
    clash = set(block) & set(allow)
    if clash:
        raise ValueError(f"keys both blocked and allowed: {sorted(clash)}")
    host, path = split_url(F.col("url"))
    labels, lengths = _shape([*block, *allow])
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    keyed = split.withColumn("keys", url_keys(F.col("host"), F.col("path"), labels, lengths))
    universe = stage(keyed.select(F.explode("keys").alias("key")).distinct(), "universe")

    def listed(rules):
        one = spark.range(1).select(F.explode(F.split(F.lit("\n".join(rules)), "\n")).alias("key"))
        return one.filter("key != ''")

    blocked, allowed = (build_cascade(listed(r), universe, max_bits) for r in (block, allow))
    if blocked is None or allowed is None:
        return _by_join(keyed, listed(block), listed(allow))

    def longest(cascade):
        found = F.filter("keys", cascade.has)
        return F.array_max(F.transform(found, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))

    judged = keyed.withColumn("b", longest(blocked)).withColumn("a", longest(allowed))
    return _verdict(judged)


def _by_join(keyed: DataFrame, block: DataFrame, allow: DataFrame) -> DataFrame:
    """Beyond the filters' size: the longest listed key per set of keys, by equi-joins."""
    lists = block.withColumn("kind", F.lit("b")).union(allow.withColumn("kind", F.lit("a")))
    sets = keyed.select("keys").distinct()
    hit = (
        sets.select("keys", F.explode("keys").alias("key")).join(lists, "key")
        .withColumn("s", F.struct(F.length("key").alias("n"), "key"))
        .groupBy("keys").agg(F.max(F.when(F.col("kind") == "b", F.col("s"))).alias("b"),
                             F.max(F.when(F.col("kind") == "a", F.col("s"))).alias("a"))
    )
    return _verdict(keyed.join(hit, "keys", "left"))


def _verdict(judged: DataFrame) -> DataFrame:
    best = F.greatest("a", "b")  # skips nulls
    return judged.select(
        "page_id", "host", "path", best["key"].alias("rule"),
        F.when(F.col("b").isNotNull() & (best == F.col("b")), "block").otherwise("allow").alias("verdict"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


SQL = f"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(rh, rp, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
  ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit AS (SELECT page_id, rh || rp AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) AS k
  FROM q JOIN rules r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT q.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM q LEFT JOIN fit ON fit.page_id = q.page_id AND k = 1
"""

"""Phrase collocations: counting word sequences with burstable tries.

Phrases up to `max_words` long are counted exactly, those of at least `min_count` are kept.

A task counts into a trie over word numbers. Near the root a node is a table of words; below, the
rest of a phrase is one key of a hash container. A container that grows beyond BURST keys bursts:
it becomes a node of smaller containers, one per next word. When the trie holds MAX_KEYS keys, its
largest subtrees are taken out whole and leave the task as sorted runs, one per prefix partition.
The partition of a phrase follows from its first two words, so a frequent first word is spread.
Runs of a partition meet in one task, which merges them as they come.

Three scans count longer and longer phrases: single words; pairs of frequent words; from there on
all lengths at once, as the longest phrase at each place whose pairs are all frequent (shorter ones
are its prefixes in the trie). What is frequent is asked of a bit table of bounded size, so a scan
may count more than needed, never less.

Words are 64-bit hashes of language and word; two frequent words of one hash are refused. The
words are joined back at the end.

Candidates are scored by their weakest cut, those mostly part of one longer phrase are dropped.

Defined results: null texts are empty; a null language is `und`; ids are not looked at, so repeated
rows count each; a text without words adds nothing; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from newsfunnel.llm.textkit import map_arrow, mix, range_hashes, rows_of, signed, slices, stage, table, words

MAX_WORDS = 4
MIN_COUNT = 30
BEST = 2000
WITHIN = 80  # percent of its occurrences that a longer phrase must hold to replace a phrase
BURST = 4096  # keys of a container
MAX_KEYS = 400_000  # keys of a task's trie
MAX_WORDS_HELD = 250_000  # distinct words a task counts before it passes them on
PARTITION_BYTES = 24 << 20  # of text per prefix partition
RUN_KEYS = 16_384  # keys of one row of a run
BITS = 27  # of the largest bit table: 16 MB

_SEPARATORS = np.zeros(256, dtype=bool)
_SEPARATORS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_SEPARATORS
_WORD[[0x20, 0x09]] = False
_ID_BITS = 21  # of a word's number within a task
_MASK = (1 << _ID_BITS) - 1


class Texts:
    """The words of one part of a batch: hashes, and which of them follow each other in a piece."""

    def __init__(self, rows: np.ndarray, chunk, salts: np.ndarray):
        self.low = chunk.lower()
        self.starts, self.ends, splits = words(self.low, chunk.offsets, _WORD)
        self.row = rows[rows_of(splits)]
        self.hash = mix(range_hashes(self.low, self.starts, self.ends) + salts[self.row])
        n = len(self.starts)
        self.joined = np.zeros(n, dtype=bool)  # the next word follows in the same piece
        if n > 1:
            seen = np.concatenate([[0], np.cumsum(_SEPARATORS[self.low], dtype=np.int64)])
            self.joined[:-1] = (seen[self.starts[1:]] == seen[self.ends[:-1]]) & (self.row[1:] == self.row[:-1])


def parts(batch: pa.RecordBatch) -> Iterator[Texts]:
    """Texts of (lang, text); each language salts the hashes of its words."""
    langs = batch.column(0).to_pylist()
    salt = {lang: _salt(lang) for lang in set(langs)}
    salts = np.array([salt[x] for x in langs], dtype=np.uint64)
    for rows, chunk in slices(batch.column(1), _SEPARATORS):
        yield Texts(rows, chunk, salts)


def _salt(lang: str) -> int:
    raw = np.frombuffer(lang.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return int(mix(~range_hashes(raw, np.array([0]), np.array([len(raw)])))[0])


# --- single words ------------------------------------------------------------------------------

_WORDS_DDL = "lang string, h long, word string, n long"


def _count_words(batches):
    held: dict[int, int] = {}  # hash -> count, in the order of `named`
    named: tuple[list, list] = ([], [])  # languages and words

    def out():
        rows = pa.RecordBatch.from_arrays([
            pa.array(named[0], pa.string()), pa.array(list(held), pa.int64()), pa.array(named[1], pa.string()),
            pa.array(list(held.values()), pa.int64())], names=["lang", "h", "word", "n"])
        for x in (held, *named):
            x.clear()
        return rows

    for batch in batches:
        langs = batch.column(0).to_pylist()
        for part in parts(batch):
            unique, first, count = np.unique(signed(part.hash), return_index=True, return_counts=True)
            raw = part.low.tobytes()
            of, begin, end = (x[first].tolist() for x in (part.row, part.starts, part.ends))
            for h, n, row, a, b in zip(unique.tolist(), count.tolist(), of, begin, end):
                if h in held:
                    held[h] += n
                else:
                    held[h] = n
                    named[0].append(langs[row])
                    named[1].append(raw[a:b].decode("utf-8", "surrogatepass"))
            if len(held) >= MAX_WORDS_HELD:
                yield out()
    yield out()


def bit_table(hashes: DataFrame, rows: int, bits: int = BITS) -> tuple[int, bytes]:
    """(bits, table) with a bit for each value of `h`; 32 bits a row as long as the bound allows."""
    size = min(bits, max(10, (32 * rows).bit_length()))
    slot = F.col("h").bitwiseAND(F.lit((1 << size) - 1))
    one = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    filled = hashes.withColumn("slot", slot).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(one).alias("set"))
    out = np.zeros(1 << size - 6, dtype=np.int64)  # at most 2^21 numbers come back
    got = filled.toArrow()
    out[got.column("at").to_numpy()] = got.column("set").to_numpy()
    return size, out.tobytes()


class Bits:
    def __init__(self, shared):
        size, raw = shared
        self.mask = np.uint64((1 << size) - 1)
        self.table = np.frombuffer(raw, dtype=np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h & self.mask
        return (self.table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a + np.uint64(0x9E3779B97F4A7C15)) + b)


# --- the trie ----------------------------------------------------------------------------------


class Node(dict):
    """Maps a word number to what follows it: another node, or a container (a plain dict) that maps
    the rest of the phrase, packed into one number, to its count."""


class Trie:
    """Counts of phrases of up to `depth` word numbers (from 1; 0 is no word)."""

    def __init__(self, depth: int):
        self.depth = depth
        self.root = Node()
        self.size: dict[int, int] = {}  # keys below each first word
        self.keys = 0

    def add(self, first: np.ndarray, rest: np.ndarray, count: np.ndarray) -> None:
        """Distinct phrases in order of (first, rest)."""
        cuts = np.flatnonzero(np.diff(first)) + 1
        begins = [0, *cuts.tolist()] if len(first) else []
        ends = [*cuts.tolist(), len(first)]
        heads, keys, counts = first.tolist(), rest.tolist(), count.tolist()
        root, size = self.root, self.size
        for a, b in zip(begins, ends):
            w = heads[a]
            below = root.get(w)
            if below is None:
                below = root[w] = {}
                size[w] = 0
            if b == a + 1 and below.__class__ is dict and len(below) < BURST:  # one phrase of a small subtree
                k, new = keys[a], keys[a] not in below
                below[k] = counts[a] if new else below[k] + counts[a]
            else:
                root[w], new = self._put(below, keys[a:b], counts[a:b], self.depth - 1)
            size[w] += new
            self.keys += new

    def _put(self, below: dict, keys: list, counts: list, left: int) -> tuple[dict, int]:
        """Add to what is below a word; `left` words may follow. (what is there now, new keys)"""
        if not isinstance(below, Node):
            before = len(below)
            get = below.get
            for k, n in zip(keys, counts):
                below[k] = get(k, 0) + n
            new = len(below) - before
            return (self._burst(below, left) if len(below) > BURST and left > 1 else below), new
        shift, new = _ID_BITS * (left - 1), 0
        i = 0
        while i < len(keys):
            w, j = keys[i] >> shift, i
            low = w << shift
            inner = []
            while j < len(keys) and keys[j] >> shift == w:
                inner.append(keys[j] - low)
                j += 1
            child = below.get(w)
            below[w], more = self._put({} if child is None else child, inner, counts[i:j], left - 1)
            new += more
            i = j
        return below, new

    def _burst(self, container: dict, left: int) -> dict:
        shift = _ID_BITS * (left - 1)
        low = (1 << shift) - 1
        node = Node()
        for k, n in container.items():
            node.setdefault(k >> shift, {})[k & low] = n
        for w, child in node.items():
            if len(child) > BURST and left > 2:
                node[w] = self._burst(child, left - 1)
        return node

    def _gather(self, below: dict, left: int, path: int, keys: list, counts: list) -> None:
        if not isinstance(below, Node):
            keys.extend([path + k for k in below] if path else below)
            counts.extend(below.values())
            return
        for w, child in below.items():
            self._gather(child, left - 1, path + (w << _ID_BITS * (left - 1)), keys, counts)

    def take(self, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Take out the largest subtrees until `keep` keys stay: (first, rest, count)."""
        first, sizes, rest, count = [], [], [], []
        for w in sorted(self.size, key=self.size.get, reverse=True):
            if self.keys <= keep:
                break
            self._gather(self.root.pop(w), self.depth - 1, 0, rest, count)
            first.append(w)
            sizes.append(self.size.pop(w))
            self.keys -= sizes[-1]
        words_, sizes, rest, count = (np.array(x, dtype=np.int64) for x in (first, sizes, rest, count))
        return np.repeat(words_, sizes), rest, count


class Counter:
    """A task's trie with its word numbers; passes sorted runs on."""

    def __init__(self, partitions: int, longest: int):
        self.partitions, self.longest = partitions, longest
        self.trie = Trie(longest)
        self.number: dict[int, int] = {}

    def add(self, hashes: np.ndarray, places: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Count the phrases of `lengths` words at `places` of a text's word hashes."""
        if not len(places):
            return
        used = np.zeros(len(hashes) + self.longest, dtype=bool)
        for i in range(self.longest):
            used[places[lengths > i] + i] = True
        used = np.flatnonzero(used)
        unique, where = np.unique(hashes[used], return_inverse=True)
        if len(self.number) + len(unique) >= _MASK:
            yield from self.runs(0)
            self.number.clear()
        number = self.number
        known = np.array([number.setdefault(h, len(number) + 1) for h in unique.tolist()], dtype=np.int64)
        ids = np.zeros(len(hashes) + self.longest, dtype=np.int64)
        ids[used] = known[where]
        rest = np.zeros(len(places), dtype=np.int64)
        for i in range(1, self.longest):
            rest = rest << _ID_BITS | np.where(lengths > i, ids[places + i], 0)
        first = ids[places]
        order = np.lexsort((rest, first))
        first, rest = first[order], rest[order]
        new = np.ones(len(first), dtype=bool)
        new[1:] = (first[1:] != first[:-1]) | (rest[1:] != rest[:-1])
        at = np.flatnonzero(new)
        self.trie.add(first[at], rest[at], np.diff(np.append(at, len(first))))
        if self.trie.keys > MAX_KEYS:
            yield from self.runs(MAX_KEYS // 2)

    def runs(self, keep: int) -> Iterator[pa.RecordBatch]:
        """Whole subtrees as sorted runs, one per prefix partition (in rows of bounded size)."""
        first, rest, count = self.trie.take(keep)
        if not len(first):
            return
        of = np.zeros(len(self.number) + 1, dtype=np.uint64)
        of[1:] = np.fromiter(self.number, dtype=np.uint64, count=len(self.number))
        columns = [of[first], *(of[rest >> _ID_BITS * (self.longest - 1 - i) & _MASK] for i in range(1, self.longest))]
        part = (pair_hash(columns[0], columns[1]) % np.uint64(self.partitions)).astype(np.int64)
        order = np.lexsort((*columns[::-1], part))
        columns, part, count = [c[order] for c in columns], part[order], count[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
        names, blobs = [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            for i in range(a, b, RUN_KEYS):
                j = min(b, i + RUN_KEYS)
                names.append(part[a])
                blobs.append(b"".join([*(c[i:j].tobytes() for c in columns), count[i:j].tobytes()]))
        for i in range(0, len(names), 64):
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[i:i + 64], pa.int32()), pa.array(blobs[i:i + 64], pa.binary())], names=["part", "run"])


def _count_task(batches, shared, partitions: int, shortest: int, longest: int):
    words_bits, pair_bits = (Bits(x) if x else None for x in shared.value)
    counter = Counter(partitions, longest)
    for batch in batches:
        for text in parts(batch):
            h = text.hash
            if not len(h):
                continue
            if pair_bits is None:
                ok = words_bits.has(h)
                follows = text.joined & ok
                follows[:-1] &= ok[1:]
            else:
                follows = text.joined.copy()
                follows[:-1] &= pair_bits.has(pair_hash(h[:-1], h[1:]))
            length = np.ones(len(h), dtype=np.int64)
            run = np.ones(len(h), dtype=bool)
            for i in range(1, longest):
                run = run.copy()
                run[:len(h) - i + 1] &= follows[i - 1:]
                run[len(h) - i + 1:] = False
                length += run
            places = np.flatnonzero(length >= shortest)
            yield from counter.add(h, places, length[places])
    yield from counter.runs(0)


# --- merging -----------------------------------------------------------------------------------


def _combined(columns: list[np.ndarray], count: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal keys as one, in order."""
    order = np.lexsort(columns[::-1])
    columns, count = [c[order] for c in columns], count[order]
    new = np.ones(len(count), dtype=bool)
    if len(count):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.add.reduceat(count, at) if len(at) else count


def _merge_task(batches, shortest: int, longest: int, least: int):
    """Runs of one prefix partition: counts of every phrase of `shortest` words and more."""
    merged = ([np.zeros(0, np.uint64)] * longest, np.zeros(0, np.int64))
    waiting, n = [], 0

    def merge():
        nonlocal merged, waiting, n
        columns = [np.concatenate([merged[0][i], *(w[i] for w in waiting)]) for i in range(longest)]
        count = np.concatenate([merged[1], *(w[longest].view(np.int64) for w in waiting)])
        merged, waiting, n = _combined(columns, count), [], 0

    for batch in batches:
        for run in batch.column(1):
            fields = np.frombuffer(run.as_py(), dtype=np.uint64).reshape(longest + 1, -1)
            waiting.append(fields)
            n += fields.shape[1]
            if n > max(500_000, len(merged[1]) // 2):
                merge()
    merge()
    columns, count = merged
    for size in range(shortest, longest + 1):
        whole = columns[size - 1] != 0
        keys, total = _combined([c[whole] for c in columns[:size]], count[whole])
        keep = total >= least
        rows = np.stack([k[keep] for k in keys], axis=1).astype(">u8").tobytes()
        width = 8 * size
        for i in range(0, int(keep.sum()), 50_000):
            part = total[keep][i:i + 50_000]
            data = rows[i * width:(i + len(part)) * width]
            yield pa.RecordBatch.from_arrays([
                pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(part), [None, pa.py_buffer(data)]).cast(pa.binary()),
                pa.array(np.full(len(part), size, np.int32)), pa.array(part)], names=["key", "words", "f"])


def _scan(docs: DataFrame, partitions: int, shortest: int, longest: int, least: int, *bits) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    runs = map_arrow(docs, lambda it: _count_task(it, shared, partitions, shortest, longest), "part int, run binary")
    placed = runs.repartitionById(partitions, F.col("part"))
    return map_arrow(placed, lambda it: _merge_task(it, shortest, longest, least), "key binary, words int, f long")


def count_phrases(docs: DataFrame, max_words: int = MAX_WORDS, least: int = MIN_COUNT,
                  partition_bytes: int = PARTITION_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases: key, words, f), (words: h, lang, word, f), (totals: lang, n); key is the hashes of
    the words, eight bytes each. Phrases and words occur at least `least` times."""
    if not 2 <= max_words <= MAX_WORDS:
        raise ValueError(f"phrases of 2 to {MAX_WORDS} words can be counted")
    narrow = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                         F.col("text").cast("string").alias("text"))
    counted = stage(
        map_arrow(narrow, _count_words, _WORDS_DDL).groupBy("lang", "h", "word").agg(F.sum("n").alias("f")), "words")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = stage(counted.filter(F.col("f") >= least), "frequent-words")
    same = frequent.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows, doubled = frequent.count(), same.count()
    if doubled:
        raise ValueError("two frequent words have the same hash")
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(1, -(-size // partition_bytes))
    word_bits = bit_table(frequent.select("h"), rows)
    pairs = stage(_scan(narrow, partitions, 2, 2, least, word_bits, None), "pairs")
    phrases = pairs
    if max_words > 2:
        hashed = stage(map_arrow(pairs.select("key"), _pair_hashes, "h long"), "pair-hashes")
        pair_bits = bit_table(hashed, hashed.count())
        phrases = pairs.unionAll(stage(_scan(narrow, partitions, 3, max_words, least, None, pair_bits), "longer"))
    return phrases, frequent, totals


def _pair_hashes(batches):
    for batch in batches:
        raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=">u8").astype(np.uint64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(signed(pair_hash(raw[:, 0], raw[:, 1])))], names=["h"])


# --- scores ------------------------------------------------------------------------------------


def collocations(docs: DataFrame, best: int = BEST, max_words: int = MAX_WORDS, least: int = MIN_COUNT,
                 within: int = WITHIN) -> DataFrame:
    """Per language the `best` phrases: lang, rank, phrase, a, l, r, n, score."""
    phrases, frequent, totals = count_phrases(docs, max_words, least)
    # h as the eight bytes that keys are made of.
    one = F.unhex(F.lpad(F.hex("h"), 16, "0"))
    known = stage(phrases.select("key", "words", "f").unionAll(
        frequent.select(one.alias("key"), F.lit(1).alias("words"), "f")), "known")
    candidates = known.filter("words >= 2")

    # A phrase that lies in a longer one goes if that has most of its occurrences.
    inside = candidates.filter("words >= 3").select(
        "f", F.explode(F.expr(
            "flatten(transform(sequence(2, words - 1), n -> transform(sequence(0, words - n), i -> substring(key, 8 * i + 1, 8 * n))))"
        )).alias("key")).groupBy("key").agg(F.max("f").alias("longer"))
    wide = "decimal(38,0)"
    kept = candidates.join(inside, "key", "left").filter(
        F.col("longer").isNull()
        | (F.lit(100).cast(wide) * F.col("longer") < F.lit(within).cast(wide) * F.col("f")))

    cuts = kept.select("key", F.col("f").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("k"), "words").select(
        "key", "a", "k", F.expr("substring(key, 1, 8 * k)").alias("left"),
        F.expr("substring(key, 8 * k + 1, 8 * (words - k))").alias("right"))
    part = known.select("key", "f")
    scored = (
        cuts.join(part.select(F.col("key").alias("left"), F.col("f").alias("l")), "left")
        .join(part.select(F.col("key").alias("right"), F.col("f").alias("r")), "right")
        .withColumn("score", F.expr("cast(2000000 as decimal(20,0)) * cast(a as decimal(18,0)) div (cast(l as decimal(20,0)) + r)"))
        .groupBy("key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))

    place = F.posexplode(F.expr("transform(sequence(0, cast(length(key) / 8 as int) - 1), i -> substring(key, 8 * i + 1, 8))"))
    spelt = (
        scored.select("key", place.alias("at", "one"))
        .join(frequent.select(one.alias("one"), "lang", "word"), "one")
        .groupBy("key").agg(F.min("lang").alias("lang"), F.expr(
            "array_join(transform(array_sort(collect_list(struct(at, word))), x -> x.word), ' ')").alias("phrase")))
    rows = scored.join(spelt, "key").select(
        "lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = rows.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= best)
    # One row per language.
    return top.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER_SQL}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, k, phrase, count(*)::BIGINT AS f FROM (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, {MAX_WORDS + 1}) AS r(k) WHERE len(w) >= k))
  GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
c AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
inside AS (
  SELECT lang, phrase, max(f) AS longer FROM (
    SELECT lang, f, array_to_string(w[i:i + n - 1], ' ') AS phrase
    FROM (SELECT lang, f, w, k, n, unnest(range(1, k - n + 2)) AS i FROM c, range(2, {MAX_WORDS}) AS r(n) WHERE n < k))
  GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer::HUGEINT < {WITHIN} * c.f::HUGEINT),
cuts AS (
  SELECT lang, phrase, f AS a, j, array_to_string(w[1:j], ' ') AS lp, array_to_string(w[j + 1:k], ' ') AS rp
  FROM (SELECT *, unnest(range(1, k)) AS j FROM kept)),
s AS (
  SELECT cuts.lang, cuts.phrase, a, j, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lp JOIN f y ON y.lang = cuts.lang AND y.phrase = rp),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank FROM best)
JOIN totals USING (lang) WHERE rank <= {BEST}
"""

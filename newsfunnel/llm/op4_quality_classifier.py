"""Quality classifier by weak labels: EM over overlapping labellers, then hashed linear scorers.

Two questions are asked of every text: is it junk, is it abusive. Heuristic labellers vote yes,
no or nothing on each; the given labels are one more labeller that abstains where there are none.
Expectation-maximisation over the counts of all vote patterns of the whole corpus estimates the
labellers' accuracies, and with them each pattern's posterior. Posteriors of a bounded sample
train one linear scorer per question over hashed features (words, beginnings of words, word
endings, repetition), by follow-the-regularised-leader. The scorer alone judges the documents.

Defined results: null, empty and wordless texts are rejected as junk with score 1; null ids keep
their row and teach nothing; several label rows of a document count as its worst; repeated rows
are judged one by one, and those of one id and text teach once; an empty table gives no rows; without any label or vote nothing is rejected
but wordless texts; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsfunnel.llm.textkit import (
    NOT_SPACE, chunks, give_back, gram_hashes, hash_sample, list_array, map_arrow, mix, range_hashes, row_key, small_batches,
    stage, table, words,
)
from newsfunnel.session import ship_package

BITS = 20
TRAIN_ROWS = 8000  # bound of the sample for each question; half yes, half no where there are enough
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.1
REJECT_JUNK, REJECT_ABUSE = 0.5, 0.3
CONFIDENT = 0.8  # posteriors between 1 - this and this do not train
PREFIXES = (4, 5, 6)  # bytes
EM_ROUNDS = 50
#: Common English insults, one labeller of abuse.
INSULTS = ("clown", "disgusting", "dumb", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>@^~=")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_CORE = np.ones(256, dtype=bool)  # bytes that may begin or end a word's core
_CORE[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False

#: Junk labellers say yes above these shares, fixed values. One more, prose, says no if all of
#: them are below a third of theirs; then come the given labels.
CUTS = {"adjacent": 0.3, "distinct": 0.7, "symbols": 0.3, "shouting": 0.3, "capitals": 0.5, "bars": 0.2,
        "trigrams": 0.5}


class _Text:
    """Words of a chunk: whole-word and core hashes, prefix hashes, and places."""

    def __init__(self, chunk):
        self.raw, self.low = chunk.data, chunk.lower()
        self.starts, self.ends, self.splits = words(self.low, chunk.offsets, NOT_SPACE)
        self.hash = range_hashes(self.low, self.starts, self.ends)
        # The core of a word has no ASCII punctuation in front or behind.
        core = _CORE[self.low]
        at = np.arange(len(core))
        following = np.minimum.accumulate(np.where(core, at, len(core))[::-1])[::-1] if len(core) else at
        before = np.maximum.accumulate(np.where(core, at, -1)) if len(core) else at
        self.core_start = np.minimum(following[self.starts], self.ends) if len(self.starts) else self.starts
        self.core_end = np.maximum(before[self.ends - 1] + 1, self.core_start) if len(self.starts) else self.ends


def _share(mask: np.ndarray) -> float:
    return float(np.count_nonzero(mask)) / max(1, len(mask))


def _signals(t: _Text, r: int, bars: np.ndarray, ending: np.ndarray, symbol: np.ndarray) -> dict[str, float]:
    i, j = int(t.splits[r]), int(t.splits[r + 1])
    h = t.hash[i:j]
    raw = t.raw[int(t.starts[i]):int(t.ends[j - 1])]
    grams = gram_hashes(h, 3)
    return {
        "adjacent": _share(h[1:] == h[:-1]),
        # Long texts repeat words by nature: only the first 400 distinct-word opportunities differ,
        # so the share is taken against what a text of this length could show.
        "distinct": 1 - len(np.unique(h)) / min(len(h), 400 + len(h) // 20) if len(h) >= 30 else 0.0,
        "symbols": _share(symbol[i:j]),
        "shouting": _share(ending[i:j] == 0x21),
        "capitals": float(np.count_nonzero(_UPPER[raw])) / max(1, int(np.count_nonzero(_LETTER[raw]))),
        "bars": _share(bars[i:j]),
        "trigrams": 1 - len(np.unique(grams)) / len(grams) if len(grams) >= 10 else 0.0,
    }


def _vote_rows(batches, insults: tuple[str, ...]):
    raw = b" ".join(w.encode() for w in insults)
    edges = np.array([0, len(raw)])
    low = np.frombuffer(raw, dtype=np.uint8)
    starts, ends, _ = words(low, edges, NOT_SPACE)
    lexicon = range_hashes(low, starts, ends)
    for batch in batches:
        junk, abuse = [], []
        for chunk in chunks(batch.column(1)):
            t = _Text(chunk)
            ending = t.raw[t.ends - 1] if len(t.ends) else np.zeros(0, np.uint8)
            symbol = _SYMBOLS[ending]
            bars = (ending == 0x7C) & (t.ends - t.starts == 1)
            hit = np.isin(range_hashes(t.low, t.core_start, t.core_end), lexicon)
            for r in range(chunk.rows):
                i, j = int(t.splits[r]), int(t.splits[r + 1])
                if i == j:
                    junk.append([0] * (len(CUTS) + 1))
                    abuse.append([0])
                    continue
                s = _signals(t, r, bars, ending, symbol)
                prose = all(s[k] < cut / 3 for k, cut in CUTS.items() if k != "distinct")
                junk.append([*(int(s[k] > cut) for k, cut in CUTS.items()), -int(prose)])
                # No hit says nothing: abuse has other words and other languages.
                abuse.append([1 if hit[i:j].any() else 0])
        n = len(batch.column(0))
        yield pa.RecordBatch.from_arrays([
            batch.column(0),
            list_array(np.array(junk, dtype=np.int32).ravel(), np.arange(n + 1) * (len(CUTS) + 1), pa.int32()),
            list_array(np.array(abuse, dtype=np.int32).ravel(), np.arange(n + 1), pa.int32()),
        ], names=["row", "junk", "abuse"])


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Vote patterns (rows; -1 no, 0 abstains, 1 yes) with counts -> posterior of yes per pattern,
    and rates[labeller, class, vote + 1]. Abstaining is a vote with rates of its own, so labellers
    that only ever say yes count for what they are worth."""
    onehot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    score = (votes == 1).sum(1) - (votes == -1).sum(1)
    post = np.where(score > 0, 0.9, np.where(score < 0, 0.1, prior))
    rates = np.zeros((votes.shape[1], 2, 3))
    for _ in range(EM_ROUNDS):
        for cls, weight in ((1, counts * post), (0, counts * (1 - post))):
            rates[:, cls] = np.einsum("pjv,p->jv", onehot, weight) + 0.5
        rates /= rates.sum(axis=2, keepdims=True)
        prior = float(np.clip((counts * post).sum() / max(1e-9, counts.sum()), 1e-3, 1 - 1e-3))
        log = np.log(prior) - np.log(1 - prior)
        log = log + np.einsum("pjv,jv->p", onehot, np.log(rates[:, 1]) - np.log(rates[:, 0]))
        post = 1 / (1 + np.exp(-np.clip(log, -40, 40)))
    return post, rates


_BUCKET = np.uint64(64 - BITS)


def feature_rows(chunk):
    """Per row of a chunk its distinct feature buckets (sorted)."""
    t = _Text(chunk)
    n = len(t.starts)
    parts = []
    whole = range_hashes(t.low, t.core_start, t.core_end)
    parts.append(whole)
    for size in PREFIXES:
        end = np.minimum(t.core_end, t.core_start + size)
        parts.append(mix(range_hashes(t.low, t.core_start, end) + np.uint64(size)))
    if n:
        # How a word ends and whether it is in capitals, symbols or the word before again.
        tail = t.raw[np.maximum(t.core_end, t.starts).clip(max=len(t.raw) - 1)].astype(np.uint64)
        tail = np.where(t.core_end < t.ends, tail, np.uint64(0)) + np.uint64(256) * np.minimum(t.ends - t.core_end, 3).astype(np.uint64)
    for r in range(chunk.rows):
        i, j = int(t.splits[r]), int(t.splits[r + 1])
        if i == j:
            yield np.zeros(0, dtype=np.int64)
            continue
        h, size = t.hash[i:j], j - i
        raw = t.raw[int(t.starts[i]):int(t.ends[j - 1])]
        kinds, count = np.unique(tail[i:j], return_counts=True)
        grams = gram_hashes(h, 3)
        shares = [
            _share(h[1:] == h[:-1]), 1 - len(np.unique(h)) / min(size, 400 + size // 20),
            float(np.count_nonzero(_UPPER[raw])) / max(1, len(raw)),
            1 - len(np.unique(grams)) / max(1, len(grams)),
        ]
        shape = [np.uint64(1000 * (k + 1) + int(10 * max(0.0, v))) for k, v in enumerate(shares)]
        shape += [np.uint64(100_000) + k * np.uint64(16) + np.uint64(int(8 * c / size)) for k, c in zip(kinds, count)]
        shape = mix(mix(np.array(shape, dtype=np.uint64)) + np.uint64(99))
        both = np.concatenate([*(p[i:j] for p in parts), shape])
        yield np.unique(both >> _BUCKET).astype(np.int64)


def _feature_batches(batches):
    for batch in batches:
        rows = [f for chunk in chunks(batch.column(1)) for f in feature_rows(chunk)]
        edge = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), list_array(flat, edge, pa.int32())], names=["task", "y", "f"])


def train_linear(rows: list[tuple[float, np.ndarray]]) -> np.ndarray:
    """Logistic weights over hashed features (the last one is the bias), FTRL-proximal."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    order = np.random.default_rng(0)

    sparse = np.full((1 << BITS) + 1, L1)
    sparse[-1] = 0.0  # the bias is never dropped

    def weights(zb, nb, l1):
        return np.where(np.abs(zb) <= l1, 0.0, -(zb - np.sign(zb) * l1) / ((BETA + np.sqrt(nb)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            y, f = rows[i]
            w = weights(z[f], n[f], sparse[f])
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -40, 40))) - y
            sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / ALPHA
            z[f] += g - sigma * w
            n[f] += g * g
    return weights(z, n, sparse)


def _train(batches):
    rows: dict[int, list] = {0: [], 1: []}
    for batch in batches:
        for task, y, f in zip(*(batch.column(i) for i in range(3))):
            rows[task.as_py()].append((y.as_py(), np.append(f.values.to_numpy(), np.int32(1 << BITS))))
    out = []
    for task in (0, 1):
        # Sorted: the order in which tasks delivered the sample has no effect.
        rows[task].sort(key=lambda r: (r[0], len(r[1]), hashlib.md5(r[1].tobytes()).digest()))
        w = train_linear(rows[task]) if rows[task] else np.append(np.zeros(1 << BITS), -3.0)
        used = np.flatnonzero(w)
        out.append((task, used, w[used]))
    yield pa.RecordBatch.from_arrays([
        pa.array([t for t, _, _ in out], pa.int32()), pa.array([u.astype(np.int32).tobytes() for _, u, _ in out]),
        pa.array([w.astype(np.float32).tobytes() for _, _, w in out]),
    ], names=["task", "used", "w"])


def _scores(texts: pa.Array, models) -> pa.Array:
    """(junk, abuse) of every text."""
    scores: list[list[float]] = [[], []]
    for chunk in chunks(texts):
        for f in feature_rows(chunk):
            for out, w in zip(scores, models):
                if len(f) == 0:
                    out.append(1.0 if out is scores[0] else 0.0)
                else:
                    out.append(float(1 / (1 + np.exp(-np.clip(w[f].sum() + w[-1], -40, 40)))))
    give_back()
    return pa.StructArray.from_arrays([pa.array(s, pa.float64()) for s in scores], names=["junk", "abuse"])


def _posteriors(patterns: DataFrame, prior: float) -> list[tuple[list[int], float, int]]:
    """(votes, posterior of yes, rows) of every pattern."""
    rows = patterns.collect()  # at most 3 ** labellers patterns
    if not rows:
        return []
    votes = np.array([r["votes"] for r in rows])
    post, _ = expectation_maximisation(votes, np.array([r["n"] for r in rows], dtype=float), prior)
    return [(r["votes"], float(p), r["n"]) for r, p in zip(rows, post)]


def train(
    docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, insults: tuple[str, ...] = INSULTS,
    id_col: str = "doc_id", text_col: str = "text",
):
    """Broadcast pair of weight arrays: junk, abuse."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = narrow.select(F.struct("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key")).alias("row"), "text")
    votes = map_arrow(
        keyed, lambda it: _vote_rows(it, insults),
        "row struct<doc_id:long,key:long>, junk array<int>, abuse array<int>").select("row.*", "junk", "abuse")
    given = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    said = lambda c, yes: F.when(F.col(c).isNull(), 0).when(F.col(c) == yes, 1).otherwise(-1)
    votes = stage(
        votes.filter("doc_id is not null").join(given, "doc_id", "left").select(
            "key", F.concat("junk", F.array(said("quality", 0))).alias("junk"),
            F.concat("abuse", F.array(said("toxic", 1))).alias("abuse")), "votes")
    picked = []
    for task, (name, prior) in enumerate((("junk", 0.1), ("abuse", 0.1))):
        patterns = votes.groupBy(F.col(name).alias("votes")).agg(F.count(F.lit(1)).alias("n"))
        post = _posteriors(patterns, prior)
        known = [(v, p) for v, p, _ in post if any(v) and not 1 - CONFIDENT < p < CONFIDENT]
        for side in (True, False):
            mine = [(v, p) for v, p in known if (p > 0.5) == side]
            if not mine:
                continue
            # Patterns and posteriors as a small constant map.
            total = sum(n for v, _, n in post if v in [m for m, _ in mine])
            probability = F.create_map(*[F.lit(x) for v, p in mine for x in (",".join(map(str, v)), p)])
            key = F.array_join(F.col(name).cast("array<string>"), ",")
            known_rows = votes.select(
                "key", F.lit(task).alias("task"), F.try_element_at(probability, key).alias("y")).filter("y is not null")
            picked.append(hash_sample(known_rows, f"{name}{side}", train_rows // 2, total))
    if not picked:
        weights = np.append(np.zeros(1 << BITS, dtype=np.float32), np.float32(-3.0))
        return spark.sparkContext.broadcast([weights, weights])
    sample = picked[0]
    for more in picked[1:]:
        sample = sample.unionByName(more)
    sample = stage(sample, "sample")
    # The sample's size is a parameter, so it may be broadcast. Of repeated rows one is taken, whatever
    # their number: they are folded where they are read.
    text = narrow.withColumn("key", row_key(F.col("doc_id"), F.col("text"))).join(F.broadcast(sample), "key").groupBy(
        "key", "task").agg(F.first("text").alias("text"), F.first("y").alias("y")).select("task", "text", "y")
    features = map_arrow(text, _feature_batches, "task int, y double, f array<int>")
    rows = map_arrow(features.repartition(1), _train, "task int, used binary, w binary").collect()
    models = [np.zeros((1 << BITS) + 1, dtype=np.float32) for _ in range(2)]
    for r in rows:
        models[r["task"]][np.frombuffer(r["used"], dtype=np.int32)] = np.frombuffer(r["w"], dtype=np.float32)
    return spark.sparkContext.broadcast(models)


def classify(
    docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, reject_junk: float = REJECT_JUNK,
    reject_abuse: float = REJECT_ABUSE, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """`docs` with p_junk, p_abuse and keep. Only the texts go to Python, once; rows stay where they are."""
    model = train(docs, labels, train_rows, id_col=id_col, text_col=text_col)
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    score = F.arrow_udf(lambda texts: _scores(texts, model.value), "struct<junk:double,abuse:double>").asNondeterministic()
    names = [c for c in docs.columns if c not in ("p_junk", "p_abuse", "keep")]
    return docs.select(*names, score(F.col(text_col).cast("string")).alias("p_junk")).select(
        *names, F.col("p_junk.junk").alias("p_junk"), F.col("p_junk.abuse").alias("p_abuse"),
        ((F.col("p_junk.junk") < reject_junk) & (F.col("p_junk.abuse") < reject_abuse)).alias("keep"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the scores of junk and abuse, and keep, for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels")).drop("text")

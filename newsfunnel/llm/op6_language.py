"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character n-grams of the lower-cased text are hashed; a weight is the n-gram's share of the text
times its inverse document frequency, which is counted over all training documents. The model is
trained with follow-the-regularised-leader and elastic-net penalties on a bounded sample, then
its scores are calibrated with one temperature on another bounded sample.

Learning uses only text and non-null language of rows whose crc32 of the id's text, mod 4, is
not 2: remainders 0 and 1 train the weights, remainder 3 the temperature.

Defined results: null texts and texts without a letter are `und` with score 0; a row with a null
id is not held out and teaches nothing; if nothing can be learned, all rows are `und`; repeated
rows are predicted one by one; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from newsfunnel.llm.textkit import list_array, map_arrow, row_key, stage, table

ORDERS = (1, 2, 3)
BITS = 16
TRAIN_ROWS = 3000  # bound of the sample that trains the weights, an equal share for each language
CALIBRATE_ROWS = 1500  # bound of the sample that sets the temperature, likewise
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.02
SCALE = 30.0  # n-gram shares are small numbers
CHUNK_CHARS = 1_000_000
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")


def gram_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram, splits): row i has ids[splits[i]:splits[i + 1]]."""
    lowered = [t.lower() for t in texts]
    lengths = np.array([len(t) for t in lowered], dtype=np.int64)
    edges = np.concatenate([[0], np.cumsum(lengths)])
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    counts = sum(np.maximum(lengths - n + 1, 0) for n in ORDERS)
    splits = np.concatenate([[0], np.cumsum(counts)])
    ids = np.empty(int(splits[-1]), dtype=np.int32)
    at = splits[:-1].copy()
    h = np.zeros(len(code), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        # Multiplicative rolling: the hash of n characters extends that of n - 1.
        h = (h[:len(code) - n + 1] * np.uint32(0x01000193)) ^ (code[n - 1:] * np.uint32(0x9E3779B1))
        if n not in ORDERS:
            continue
        bucket = ((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.int32)
        for r, size in enumerate(lengths):
            k = size - n + 1
            if k > 0:
                ids[at[r]:at[r] + k] = bucket[edges[r]:edges[r] + k]
                at[r] += k
    return ids, splits


def _groups(texts: list[str | None]):
    """Rows in lots of about CHUNK_CHARS characters; a longer text is a lot of its own."""
    lot: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if lot and size + len(t or "") > CHUNK_CHARS:
            yield lot
            lot, size = [], 0
        lot.append(i)
        size += len(t or "")
    if lot:
        yield lot


def _document_frequency(batches):
    total = np.zeros(1 << BITS, dtype=np.int64)
    rows = 0
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for lot in _groups(texts):
            ids, splits = gram_ids([texts[i] or "" for i in lot])
            seen = np.zeros(1 << BITS, dtype=bool)
            for a, b in zip(splits[:-1], splits[1:]):
                seen[:] = False
                seen[ids[a:b]] = True
                total += seen
            rows += len(lot)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(used, -1)), pa.array(np.append(total[used], rows))], names=["bucket", "n"])


def _features(batches):
    """(cls, rnd, bucket list, share list) of sampled rows."""
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for lot in _groups(texts):
            ids, splits = gram_ids([texts[i] or "" for i in lot])
            keys, shares, edge = [], [], [0]
            for a, b in zip(splits[:-1], splits[1:]):
                value, count = np.unique(ids[a:b], return_counts=True)
                keys.append(value)
                shares.append(count / max(1, b - a))
                edge.append(edge[-1] + len(value))
            edge = np.array(edge)
            yield pa.RecordBatch.from_arrays([
                batch.column(1).take(pa.array(lot)), batch.column(2).take(pa.array(lot)),
                list_array(np.concatenate(keys), edge, pa.int32()),
                list_array(np.concatenate(shares), edge, pa.float64()),
            ], names=["cls", "fold", "buckets", "shares"])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int) -> np.ndarray:
    """Weights (buckets x classes) by per-coordinate FTRL-proximal with L1 and L2."""
    z = np.zeros((1 << BITS, classes))
    n = np.zeros((1 << BITS, classes))
    order = np.random.default_rng(0)

    def weights(zb, nb):
        w = -(zb - np.sign(zb) * L1) / ((BETA + np.sqrt(nb)) / ALPHA + L2)
        return np.where(np.abs(zb) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            y, b, x = rows[i]
            w = weights(z[b], n[b])
            p = softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[b] + g * g) - np.sqrt(n[b])) / ALPHA
            z[b] += g - sigma * w
            n[b] += g * g
    return weights(z, n)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss: golden search over its logarithm."""
    def loss(t):
        p = softmax(logits / np.exp(t))[np.arange(len(y)), y]
        return -np.log(np.maximum(p, 1e-12)).mean()

    a, b = -3.0, 3.0
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(50):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def _train(batches, idf: np.ndarray, classes: int):
    train, hold = [], []
    for batch in batches:
        for y, fold, b, x in zip(*(batch.column(i) for i in range(4))):
            b = b.values.to_numpy()
            row = (y.as_py(), b, x.values.to_numpy() * idf[b] * SCALE)
            (hold if fold.as_py() == 3 else train).append(row)
    # Sorted: the order in which tasks delivered the sample has no effect.
    for rows in (train, hold):
        rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    w = train_ftrl(train, classes)
    t = 1.0
    if hold:
        t = fit_temperature(np.array([x @ w[b] for _, b, x in hold]), np.array([y for y, _, _ in hold]))
    yield pa.RecordBatch.from_arrays(
        [pa.array([w.astype(np.float32).tobytes()]), pa.array([t])], names=["w", "t"])


def _predict(batches, model, labels: list[str]):
    table_, temperature = model.value
    for batch in batches:
        texts = batch.column(2).to_pylist()
        best, score = [None] * len(texts), [0.0] * len(texts)
        for lot in _groups(texts):
            ids, splits = gram_ids([texts[i] or "" for i in lot])
            logits = np.zeros((len(lot), len(labels)))
            size = np.diff(splits)
            some = np.flatnonzero(size)
            for c in range(len(labels)):
                if len(some):
                    logits[some, c] = np.add.reduceat(table_[c][ids], splits[:-1][some]) / size[some]
            p = softmax(logits / temperature)
            top = p.argmax(axis=1)
            for k, i in enumerate(lot):
                if texts[i] is not None and _LETTER.search(texts[i]):
                    best[i], score[i] = labels[top[k]], float(p[k, top[k]])
                else:
                    best[i] = UNKNOWN
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(best, pa.string()), pa.array(score, pa.float64())],
            names=["doc_id", "held_out", "lang_pred", "score"])


def _sample_each(rows: DataFrame, sizes, share: dict[bool, int]) -> DataFrame:
    """Keys of both samples: of every language at most its `share` of each, chosen by hash, so rare
    languages are learnt too. A threshold for each leaves about twice as many before they are sorted."""
    kind = F.struct("lang", "calibrates")
    limit = F.coalesce(*[
        F.when((F.col("lang") == r["lang"]) & (F.col("calibrates") == r["calibrates"]),
               F.lit(min(1 << 30, int(2 * share[r["calibrates"]] / r["count"] * (1 << 30)) + 1)))
        for r in sizes])
    h = F.xxhash64(F.lit("sample"), "key")
    some = rows.filter(F.pmod(h, F.lit(1 << 30)) < limit).dropDuplicates(["key"])
    place = F.row_number().over(Window.partitionBy(kind).orderBy(h, "key"))
    wanted = F.when(F.col("calibrates"), share[True]).otherwise(share[False])
    return some.withColumn("place", place).filter(F.col("place") <= wanted).select("key")


def identify_languages(
    docs: DataFrame, train_rows: int = TRAIN_ROWS, calibrate_rows: int = CALIBRATE_ROWS,
) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of `docs` (doc_id, text, lang)."""
    spark = docs.sparkSession
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", fold.alias("fold"))
    learn = docs.filter("fold != 2 and lang is not null and text is not null")
    sizes = learn.groupBy("lang", (F.col("fold") == 3).alias("calibrates")).count().collect()  # languages
    labels = sorted({r["lang"] for r in sizes})
    everything = docs.select("doc_id", F.coalesce(F.col("fold") == 2, F.lit(False)).alias("held_out"), "text")
    if not labels:
        return everything.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    # One row per bucket, whatever the corpus.
    counts = (
        map_arrow(learn.filter("fold != 3").select("text"), _document_frequency, "bucket long, n long")
        .groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    )
    df = np.zeros(1 << BITS)
    total = 0
    for r in counts:
        if r["bucket"] < 0:
            total = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    idf = np.log((1 + total) / (1 + df)) + 1
    number = F.array_position(F.lit(labels), F.col("lang")).cast("int") - 1
    learn = learn.withColumn("key", row_key(F.col("doc_id"), F.col("text"))).withColumn("calibrates", F.col("fold") == 3)
    share = {False: -(-train_rows // len(labels)), True: -(-calibrate_rows // len(labels))}
    chosen = stage(_sample_each(learn.select("key", "lang", "calibrates"), sizes, share), "chosen")
    # The samples' sizes are parameters, so their keys may be broadcast. Repeated rows are folded
    # where they are read.
    sample = learn.join(F.broadcast(chosen), "key", "left_semi").groupBy("key").agg(
        F.first("text").alias("text"), F.first(number).alias("cls"), F.first(F.col("fold").cast("int")).alias("fold")
    ).drop("key")
    features = map_arrow(
        sample, _features, "cls int, fold int, buckets array<int>, shares array<double>")
    # The bounded sample meets in one task.
    row = map_arrow(
        features.repartition(1), lambda it: _train(it, idf, len(labels)), "w binary, t double").first()
    w = np.frombuffer(row["w"], dtype=np.float32).reshape(1 << BITS, len(labels))
    by_class = np.ascontiguousarray((w * idf[:, None] * SCALE).astype(np.float32).T)
    model = spark.sparkContext.broadcast((by_class, row["t"]))
    return map_arrow(
        everything, lambda it: _predict(it, model, labels),
        "doc_id long, held_out boolean, lang_pred string, score double")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))

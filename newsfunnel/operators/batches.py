"""Batch scoring: pack rows, render requests, call a user function, match answers back.

The scoring function is supplied by the caller and receives a list of row dicts. A batch
is one row holding at most `size` items, so whatever the data looks like a task never holds
more than one small batch per call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsfunnel import dims
from newsfunnel.functions import model_json
from newsfunnel.operators.numbering import with_ordinal_joined
from newsfunnel.session import cut_lineage, map_batches, path_exists


class FatalScoringError(Exception):
    """Raised by a scorer when the whole run is invalid; it fails the job instead of turning
    the batch into missing answers."""


def pack_batches(df: DataFrame, size: int, order: list[Column]) -> DataFrame:
    """Add batch (from 0) and n (1..size): consecutive chunks of the rows in `order`."""
    return with_ordinal_joined(df, order, "_ord").withColumns({
        "batch": F.floor(F.col("_ord") / size).cast("bigint"),
        "n": (F.col("_ord") % size + 1).cast("int"),
    }).drop("_ord")


def gather_batches(packed: DataFrame, columns: list[str]) -> DataFrame:
    """One row per batch: (batch, items), items sorted by n."""
    return packed.groupBy("batch").agg(
        F.sort_array(F.collect_list(F.struct("n", *columns))).alias("items")
    )


def render_requests(
    packed: DataFrame, line: Column, separator: str = "\n",
    tokens_per_item: int = 16, tokens_base: int = 32,
) -> DataFrame:
    """(batch, n_items, prompt, max_tokens): the prompt lines of a batch in n order."""
    lines = packed.select("batch", "n", line.alias("line"))
    return gather_batches(lines, ["line"]).select(
        "batch",
        F.size("items").alias("n_items"),
        F.array_join(F.transform("items", lambda i: i["line"]), separator).alias("prompt"),
        (F.size("items") * tokens_per_item + tokens_base).alias("max_tokens"),
    )


def score_batches(
    packed: DataFrame, fn: Callable[[list[dict]], str], columns: list[str],
    parallel: int | None = None, ledger: str | None = None, scorer: str = "",
) -> DataFrame:
    """(batch, response, error): `fn` called once per batch; its answer is text. If it failed the
    answer is NULL and `error` says why.

    `parallel` bounds the calls in flight by the number of partitions. The caller should
    materialise the result: a second evaluation would call `fn` again.

    With a `ledger` (a folder that outlives the run) answers are kept under the digest of `scorer`
    and the batch's items; a batch that has an answer there is not asked again, one that failed is.
    """
    batches = gather_batches(packed, columns)

    def call(items) -> tuple[str | None, str | None]:
        rows = [i if isinstance(i, dict) else i.asDict() for i in items]
        try:
            return fn(rows), None
        except FatalScoringError:
            raise
        except Exception as error:  # one bad batch must not cost the others
            return None, f"{type(error).__name__}: {error}"

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = [call(i) for i in frame["items"]]
            yield pd.DataFrame({
                frame.columns[0]: frame.iloc[:, 0],
                "response": pd.Series([a for a, _ in answers], dtype=object),
                "error": pd.Series([e for _, e in answers], dtype=object),
            })

    def asked(rows: DataFrame, key: str, kind: str) -> DataFrame:
        if parallel:
            rows = rows.repartition(parallel, key)
        return map_batches(rows, score, f"{key} {kind}, response string, error string")

    if ledger is None:
        return asked(batches, "batch", "bigint")
    digest = F.sha2(F.concat(F.lit(f"{scorer}\n"), F.to_json("items")), 256)
    batches = cut_lineage(batches.withColumn("digest", digest), "batches")
    answers = stored_by_key(
        batches.sparkSession, ledger, "digest string, response string, error string", "response is not null")
    new = batches.select("digest", "items").join(answers, "digest", "left_anti").dropDuplicates(["digest"])
    asked(new, "digest", "string").write.mode("append").parquet(ledger)
    said = batches.sparkSession.read.parquet(ledger).groupBy("digest").agg(
        F.max("response").alias("response"), F.max("error").alias("error"))
    return batches.select("batch", "digest").join(said, "digest").select(
        "batch", "response", F.when(F.col("response").isNull(), F.col("error")).alias("error"))


def stored_by_key(spark: SparkSession, path: str, ddl: str, usable: str) -> DataFrame:
    """Keys (the first column of `ddl`) that the append-only store at `path` has usable rows for."""
    rows = (spark.read.schema(ddl).parquet(path) if path_exists(spark, path)
            else spark.createDataFrame([], ddl))
    return rows.filter(usable).select(rows.columns[0]).distinct()


def failed_batches(stage: str, answers: DataFrame) -> DataFrame:
    """(stage, batches, failed, error): how many calls of a scorer failed, and one of the reasons."""
    return answers.agg(
        F.count(F.lit(1)).alias("batches"), F.count("error").alias("failed"), F.min("error").alias("error")
    ).select(F.lit(stage).alias("stage"), "batches", "failed", "error")


def match_by_echo(packed: DataFrame, responses: DataFrame, list_path: str = "$.v") -> DataFrame:
    """Add `answer` (VARIANT) to every packed row: the entry of its batch's response that
    echoes its n.

    Matching is by the echoed number, never by position. For repeated numbers the last entry
    wins; rows nobody answered get NULL, which is not the same as a no.
    """
    entries = responses.select(
        "batch", model_json.parse_model_json(F.col("response")).alias("_v")
    ).select(
        "batch",
        F.posexplode(F.try_variant_get("_v", list_path, "array<variant>")).alias("pos", "entry"),
    )
    n = model_json.number_at(F.col("entry"), "$.n")
    # Whole numbers only: 1.5 echoes no row.
    echoed = entries.withColumn("n", F.when(n == F.floor(n), n).cast("int"))
    last = echoed.filter("n is not null").groupBy("batch", "n").agg(
        F.max_by(F.to_json("entry"), "pos").alias("answer_json")
    )
    return packed.join(last, ["batch", "n"], "left").withColumn(
        "answer", F.try_parse_json("answer_json")
    ).drop("answer_json")


def screen_flag(answer: Column) -> Column:
    """True for d = 1 or true, false for any other answer, NULL for no answer."""
    d = model_json.scalar_at(answer, "$.d")
    kind = F.schema_of_variant(F.try_variant_get(answer, "$.d", "variant"))
    yes = (kind != "STRING") & (d.isin("true", "1") | (d.try_cast("double") == 1))
    return F.when(answer.isNotNull(), F.coalesce(yes, F.lit(False)))


def embed_column(
    df: DataFrame, fn: Callable[[list[str]], list], id_col: str = "id", text_col: str = "text",
    dim: int = dims.EMBED_DIM, size: int = dims.EMBED_BATCH, store: str | None = None,
) -> DataFrame:
    """(id, embedding): `fn` over lists of at most `size` texts, blank ones sent as 'empty'.

    Vectors stay keyed by id. A wrong number of vectors or a wrong width fails the job. With a
    `store` (a folder that outlives the run, one per model) vectors are kept by the digest of their
    text: equal texts are sent once, and texts that have a vector there are not sent.
    """

    def embed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [t.strip() or "empty" for t in frame["text"].fillna("")]
            vectors = []
            for i in range(0, len(texts), size):
                chunk = texts[i:i + size]
                out = list(fn(chunk))
                if len(out) != len(chunk):
                    raise ValueError(f"got {len(out)} vectors for {len(chunk)} texts")
                vectors.extend(out)
            if any(len(v) != dim for v in vectors):
                raise ValueError(f"vectors must be {dim} wide")
            yield pd.DataFrame({frame.columns[0]: frame.iloc[:, 0], "embedding": vectors})

    plain = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    if store is None:
        return map_batches(plain, embed, "id string, embedding array<float>")
    plain = cut_lineage(plain.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256)), "texts")
    known = stored_by_key(plain.sparkSession, store, "digest string, embedding array<float>", f"size(embedding) = {dim}")
    new = plain.select("digest", "text").join(known, "digest", "left_anti").dropDuplicates(["digest"])
    map_batches(new, embed, "digest string, embedding array<float>").write.mode("append").parquet(store)
    vectors = plain.sparkSession.read.parquet(store).filter(f"size(embedding) = {dim}").dropDuplicates(["digest"])
    return plain.select("id", "digest").join(vectors, "digest").select("id", "embedding")

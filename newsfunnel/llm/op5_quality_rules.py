"""Quality rules: fixed base rules, then tokeniser fertility with bands per language and script.

Two public vocabularies measure every whole text: characters per byte-level BPE token, entropy of
those tokens relative to the most it could be, and the share of byte-fallback pieces among the
pieces of a second vocabulary. For every group (language, script, length class) the quartiles over
all rows that pass the base rules give the band; a text outside the band is rejected. Small groups
use the band of their script and length class, then that of the length class. The script is that of
most letters.

Defined results: null text has no words, so the base rules reject it; a null language is the
group "und"; null ids are kept as rows; repeated rows are judged one by one; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsfunnel.llm.textkit import NOT_SPACE, chunks, gram_hashes, map_arrow, range_hashes, stage, table, words
from newsfunnel.llm.tokens import both_bpe

MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
BAND = 2.0  # quartile distances beyond the quartiles
SLACK = {"chars_per_token": 0.1, "entropy": 0.02, "fallback": 0.01}  # least width beyond a quartile
BROADCAST_BANDS = 10_000  # bands that may be broadcast (some 100 bytes each)
LEAST_GROUP = 100  # rows that a group's own band needs

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(SYMBOLS)] = 1
_HEAD = np.ones(256, dtype=np.int64)  # bytes that begin a code point
_HEAD[0x80:0xC0] = 0
#: First and last code points of the blocks of each script.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)], "cyrillic": [(0x400, 0x52F)], "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)], "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "devanagari": [(0x900, 0x97F)], "bengali": [(0x980, 0x9FF)], "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)], "odia": [(0xB00, 0xB7F)], "tamil": [(0xB80, 0xBFF)], "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)], "malayalam": [(0xD00, 0xD7F)], "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)], "lao": [(0xE80, 0xEFF)], "tibetan": [(0xF00, 0xFFF)], "myanmar": [(0x1000, 0x109F)],
    "georgian": [(0x10A0, 0x10FF)], "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "ethiopic": [(0x1200, 0x137F)], "khmer": [(0x1780, 0x17FF)], "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x3FFFF)],
}
_SCRIPT_NAMES = ["none", *SCRIPTS]
_SCRIPT = np.zeros(0x40001, dtype=np.uint8)  # all further code points share the last place
for _i, _blocks in enumerate(SCRIPTS.values(), 1):
    for _first, _last in _blocks:
        _SCRIPT[_first:_last + 1] = _i

_FIELDS = [
    ("doc_id", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()), ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("script", pa.string()), ("n_tokens", pa.int64()), ("chars_per_token", pa.float64()),
    ("entropy", pa.float64()), ("fallback", pa.float64()),
]
_SCHEMA = pa.schema(_FIELDS)
_DDL = ("doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, script string, n_tokens long, chars_per_token double, entropy double, "
        "fallback double")


def repeated_words(h: np.ndarray, k: int = 3) -> int:
    """Words inside k-word windows that occur twice or more."""
    grams = gram_hashes(h, k)
    if len(grams) < 2:
        return 0
    value, index, count = np.unique(grams, return_inverse=True, return_counts=True)
    if len(value) == len(grams):
        return 0
    again = np.flatnonzero(count[index] > 1)
    cover = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + k, -1)
    return int(np.count_nonzero(np.cumsum(cover[:-1])))


def duplicate_lines(text: str) -> int:
    seen, out = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            out += line in seen
            seen.add(line)
    return out


def token_entropy(ids: np.ndarray) -> float:
    """Entropy of the tokens over the most that as many tokens can have (1 if all differ)."""
    if len(ids) < 2:
        return 1.0
    _, count = np.unique(ids, return_counts=True)
    p = count / len(ids)
    return float(-(p * np.log(p)).sum() / np.log(len(ids)))


def _measure(batches, byte_path: str | None, piece_path: str | None):
    both = both_bpe(byte_path, piece_path)
    for batch in batches:
        texts = batch.column(1)
        columns: list[list] = [[] for _ in range(10)]
        for chunk in chunks(texts):
            data = chunk.data
            starts, ends, splits = words(data, chunk.offsets, NOT_SPACE)
            h = range_hashes(data, starts, ends)
            heads = np.concatenate([[0], np.cumsum(_HEAD[data])])
            word_heads = np.concatenate([[0], np.cumsum(heads[ends] - heads[starts])])
            symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
            points = np.frombuffer(
                data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype="<u4")
            scripts = _SCRIPT[np.minimum(points, 0x40000)]
            for r in range(chunk.rows):
                a, b = int(chunk.offsets[r]), int(chunk.offsets[r + 1])
                i, j = int(splits[r]), int(splits[r + 1])
                text = texts[chunk.first + r].as_py() or ""
                packed, n_pieces, fallback = both.measure(text)
                ids = np.frombuffer(packed, dtype="<u4")
                script = np.bincount(scripts[heads[a]:heads[b]], minlength=len(_SCRIPT_NAMES))
                script[0] = 0
                row = (
                    j - i, int(word_heads[j] - word_heads[i]), int(symbols[b] - symbols[a]),
                    duplicate_lines(text), repeated_words(h[i:j]),
                    _SCRIPT_NAMES[int(script.argmax())], len(ids), len(text) / max(1, len(ids)),
                    token_entropy(ids), fallback / max(1, n_pieces),
                )
                for column, value in zip(columns, row):
                    column.append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), *(pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS[2:]))],
            schema=_SCHEMA)


def _bands(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and measure [low, high] from its quartiles over all rows."""
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("size"),
        *[F.percentile_approx(m, [0.25, 0.75], 10_000).alias(m) for m in SLACK])
    edges = []
    for m, slack in SLACK.items():
        wide = F.greatest(F.lit(BAND) * (F.col(m)[1] - F.col(m)[0]), F.lit(slack))
        edges.append(F.struct((F.col(m)[0] - wide).alias("low"), (F.col(m)[1] + wide).alias("high")).alias(m))
    return out.select(*keys, "size", *edges)


def quality_rules(
    docs: DataFrame, min_words: int = MIN_WORDS, byte_vocabulary: str | None = None,
    piece_vocabulary: str | None = None,
) -> DataFrame:
    """All measures, base_failed and kept for every row of `docs` (doc_id, text, lang)."""
    measured = stage(
        map_arrow(
            docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")),
            lambda it: _measure(it, byte_vocabulary, piece_vocabulary), _DDL)
        .withColumn("base_failed", F.expr(
            f"n_words < {min_words} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words"))
        .withColumn("size_class", F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int")), "measured")
    good = measured.filter("not base_failed")
    out = measured
    # Groups are languages x scripts x length classes: few, whatever the corpus.
    for i, keys in enumerate((["lang", "script", "size_class"], ["script", "size_class"], ["size_class"])):
        bands = _bands(good, keys)
        if i < 2:
            bands = bands.filter(F.col("size") >= LEAST_GROUP)
        bands = stage(bands.select(*keys, F.struct(*SLACK).alias(f"band{i}")), "bands")
        if bands.count() <= BROADCAST_BANDS:
            bands = F.broadcast(bands)
        out = out.join(bands, keys, "left")
    band = F.coalesce("band0", "band1", "band2")
    inside = F.lit(True)
    for m in SLACK:
        inside = inside & F.col(m).between(band[m]["low"], band[m]["high"])
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"),
        "chars_per_token", F.col("entropy").alias("token_entropy"), F.col("fallback").alias("byte_fallback_share"),
        "script")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))

"""Histogram sort, phrase tries and term-at-a-time search against brute force and odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from newsfunnel.llm import op11_sharding as op11, op12_phrases as op12, op13_search as op13, textkit

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, rank string, key string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, "mine", "mine", "mine") for i, t, lang in rows], DOCS)


# --- sharding ----------------------------------------------------------------------------------


def brute_shards(rows, shards, tolerance):
    """[(text, id, shard, slot)] by sorting everything."""
    items = sorted(
        (hashlib.md5((t or "").encode()).digest(), i is not None, i or 0, len((t or "").encode()) + 1, t) for i, t, _ in rows)
    ends = np.cumsum([x[3] for x in items]).tolist()
    begins = [0, *ends[:-1]]
    total = ends[-1]
    cuts = []
    for k in range(1, shards):
        goal = total * k // shards
        at = next(j for j in range(len(items)) if begins[j] <= goal < ends[j])
        same = [j for j in range(len(items)) if items[j][0] == items[at][0]]
        first, past = begins[same[0]], ends[same[-1]]
        if min(goal - first, past - goal) <= tolerance * total / shards:
            cuts.append(first if goal - first <= past - goal else past)
        else:
            cuts.append(begins[at] if goal - begins[at] <= ends[at] - goal else ends[at])
    slots, out = collections.Counter(), []
    for b, (_, known, i, size, t) in zip(begins, items):
        shard = sum(c <= b for c in cuts)
        out.append((t or "", i if known else None, size, shard, slots[shard]))
        slots[shard] += 1
    return collections.Counter(out)


def shard_rows(spark, docs, path, **options):
    op11.write_shards(docs, path, **options)
    return op11.read_shards(spark, path, docs)


@pytest.mark.parametrize("probes", [4, 64])
def test_shards_equal_a_full_sort(spark, tmp_path, probes, monkeypatch):
    rng = random.Random(3)
    texts = ["x" * rng.randrange(1, 400) + str(rng.random()) for _ in range(150)] + [None, "", "", "é" * 50]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(1000 + i, "a copy that many rows have", "en") for i in range(90)]
    rows += [(None, "no id", "en"), (None, texts[0], "en"), (-5, "negative", None)]
    monkeypatch.setattr(op11, "PROBES", probes)
    find = op11.find_cuts
    monkeypatch.setattr(op11, "find_cuts", lambda *a: find(*a, probes=probes))
    docs = docs_of(spark, rows).repartition(5)
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for tolerance in (0.0, 0.05):
        got = shard_rows(spark, docs, str(tmp_path / f"t{tolerance}"), shards=5, tolerance=tolerance, part_bytes=1500).collect()
        want = brute_shards(rows, 5, tolerance)
        assert collections.Counter((r["doc"]["text"] or "", r["doc"]["doc_id"], r["size"], r["shard"], r["slot"]) for r in got) == want
        assert all(r["doc"]["shard"] == "mine" for r in got)


def test_shards_of_repeated_rows_few_rows_and_none(spark, tmp_path):
    same = docs_of(spark, [(7, "the same row", "en")] * 400)
    got = shard_rows(spark, same, str(tmp_path / "same"), shards=8).collect()
    for shard in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots))) and abs(len(slots) - 50) <= 2
    few = shard_rows(spark, docs_of(spark, [(1, "a", "en"), (2, "b", "en")]), str(tmp_path / "few")).collect()
    assert len(few) == 2
    assert shard_rows(spark, docs_of(spark, []), str(tmp_path / "none")).count() == 0


def test_half_byte_crc_is_crc32():
    value = 0xFFFFFFFF
    for byte in "ab ü".encode():
        for half in (byte & 15, byte >> 4):
            value = value >> 4 ^ op11._crc_steps()[(value ^ half) & 15]
    assert value ^ 0xFFFFFFFF == zlib.crc32("ab ü".encode())


# --- phrases -----------------------------------------------------------------------------------


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_counts(rows, longest, least):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i:i + k])] += 1
    return {k: v for k, v in f.items() if v >= least}, n


def brute_collocations(rows, best, least):
    f, n = brute_counts(rows, 4, least)
    out = collections.defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) < 2:
            continue
        inside = [b for (other, x), b in f.items() if other == lang and len(x) > len(w)
                  and any(x[i:i + len(w)] == w for i in range(len(x) - len(w) + 1))]
        if any(100 * b >= 80 * a for b in inside):
            continue
        score, k = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, r + 1, p.decode(), -a, left, right, n[lang], -s)
            for lang, found in out.items() for r, (s, a, p, left, right) in enumerate(sorted(found)[:best])}


@pytest.fixture(scope="module")
def phrase_rows():
    rng = random.Random(8)
    rows = []
    for i in range(120):
        lang = rng.choice(["en", "de", None])
        w = [rng.choice("the of and a b c d en de é".split()) for _ in range(rng.randrange(0, 60))]
        text = "".join(x + rng.choice([" ", " ", " ", "\t", ", ", ".\n", "\xa0 "]) for x in w)
        if i % 3 == 0:
            text += " New York City hall is here. New York, city"
        rows.append((i % 40, text, lang))
    return rows + [(1, None, "en"), (2, "", None), (3, ".,;\n \t", "xx")]


def test_phrases_equal_brute_force(spark, phrase_rows):
    docs = docs_of(spark, phrase_rows).repartition(4)
    got = {tuple(r) for r in op12.collocations(docs, best=25, least=5).collect()}
    assert got == brute_collocations(phrase_rows, 25, 5)
    assert op12.collocations(docs.limit(0)).count() == 0


def test_tries_burst_and_spill_without_losing_counts(monkeypatch):
    monkeypatch.setattr(op12, "BURST", 6)
    monkeypatch.setattr(op12, "MAX_KEYS", 300)
    monkeypatch.setattr(op12, "RUN_KEYS", 17)
    rng = np.random.default_rng(4)
    counter = op12.Counter(3, 4)
    want, batches = collections.Counter(), []
    for _ in range(30):
        h = rng.integers(1, 12, 200).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        length = rng.integers(1, 5, 200)
        places = np.flatnonzero((np.arange(200) + length <= 200) & (length >= 2))
        for p in places:
            for k in range(2, int(length[p]) + 1):
                want[tuple(h[p:p + k].tolist())] += 1
        batches += list(counter.add(h, places, length[places]))
    assert any(isinstance(x, op12.Node) for x in counter.trie.root.values())
    assert len(batches) > 1  # subtrees have left on the way
    batches += list(counter.runs(0))
    assert counter.trie.keys == 0 and not counter.trie.root
    got = collections.Counter()
    for part in range(3):
        mine = [b.filter(pa.compute.equal(b.column(0), part)) for b in batches]
        for out in op12._merge_task(mine, 2, 4, 1):
            for key, n, f in zip(*(c.to_pylist() for c in out.columns)):
                words = tuple(np.frombuffer(key, dtype=">u8").tolist())
                assert len(words) == n and words not in got
                got[words] = f
    assert got == want


def test_long_texts_are_read_in_parts_with_equal_results(spark):
    rng = random.Random(2)
    text = " ".join(rng.choice(["alpha", "beta", "gamma,", "delta."]) for _ in range(500_000))  # 3 MB
    rows = [(1, text, "en")]
    f, _ = brute_counts(rows, 2, 30)
    phrases, words, totals = op12.count_phrases(docs_of(spark, rows), 2)
    assert totals.first()["n"] == 500_000
    assert {r["word"]: r["f"] for r in words.collect()} == {w[0]: n for (_, w), n in f.items() if len(w) == 1}
    assert sorted(r["f"] for r in phrases.collect()) == sorted(n for (_, w), n in f.items() if len(w) == 2)
    parts = list(textkit.slices(pa.array(["x", text]), op13._BREAK, 100_000))
    assert len(parts) > 20 and b"".join(c.data.tobytes() for _, c in parts) == ("x" + text).encode()


# --- search ------------------------------------------------------------------------------------


def brute_search(rows, items, best):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    docs = [(i, collections.Counter(terms(t)), len(terms(t))) for i, t, _ in rows]
    big_n, big_l = sum(n > 0 for _, _, n in docs), sum(n for _, _, n in docs)
    df = collections.Counter(t for _, c, _ in docs for t in c)
    wanted = collections.defaultdict(collections.Counter)
    for item, text in items:
        wanted[item].update(terms(text))
    out = {}
    for item, query in wanted.items():
        found = []
        for i, c, n in docs:
            if n:
                m = 75 + 25 * n * big_n // big_l
                s = sum(r * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                        for t, r in query.items() if c[t])
                if s > 0:
                    found.append((-s, i is None, i or 0))
        out[item] = [(None if none else i, -s) for s, none, i in sorted(found)[:best]]
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize("block,max_terms", [(op13.BLOCK, op13.MAX_TERMS), (7, 40)])
def test_search_equals_brute_force(spark, block, max_terms):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)] + ["Élan", "été", "X1"]
    pick = lambda n: " ".join(vocabulary[int(rng.paretovariate(0.6)) % len(vocabulary)] + rng.choice(["", "-", "."]) for _ in range(n))
    rows = [(i, pick(rng.choice([1, 5, 40, 200])), "en") for i in range(150)]
    rows += [(150 + i, rows[3][1], "en") for i in range(30)]  # ties
    rows += [(3, rows[3][1], "en"), (None, rows[3][1], "en"), (500, None, "en"), (501, "", "en"), (502, "-- !", None)]
    items = [(i, pick(rng.choice([1, 8, 30]))) for i in range(25)] + [(3, pick(5)), (98, None), (99, "unknown words only")]
    got = collections.defaultdict(list)
    found = op13.ranked_search(
        docs_of(spark, rows).repartition(3), spark.createDataFrame(items, "item_id long, text string"),
        best=6, block=block, max_terms=max_terms).collect()
    for r in sorted(found, key=lambda r: (r["item_id"], r["rank"])):
        got[r["item_id"]].append((r["doc_id"], r["score"]))
        assert r["rank"] == len(got[r["item_id"]])
    assert got == brute_search(rows, items, 6)


def test_accumulators_stop_and_stay_exact():
    """Rare terms decide: documents that only have the common term get no accumulator."""
    n = np.full(1000, 100, dtype=np.int64)
    terms = np.concatenate([np.zeros(5, np.int64), np.ones(1000, np.int64)])
    doc = np.concatenate([np.arange(5), np.arange(1000)])
    order = np.argsort(doc, kind="stable")
    splits = np.searchsorted(doc[order], np.arange(1001))
    block = op13.Block(np.arange(1000), n, terms[order], np.ones(1005, np.int64), splits, np.array([9000, 5]), 1000, 100_000)
    score, found = block.rank([(0, 1), (1, 1)], 3, 0)
    assert block.held.sum() == 5 and set(found) <= set(range(5)) and len(set(score.tolist())) == 1
    assert score[0] == block.adds[0] + block.adds[-1]


def test_search_over_nothing(spark):
    none = docs_of(spark, [])
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert op13.ranked_search(none, items).count() == 0
    assert op13.ranked_search(docs_of(spark, [(1, "a", "en")]), items.limit(0)).count() == 0

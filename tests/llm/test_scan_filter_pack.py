"""Decontamination, URL cascade and packing against brute force."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from newsfunnel.llm.op2_decontaminate import find_contamination
from newsfunnel.llm.op3_url_filter import build_cascade, filter_urls
from newsfunnel.llm.op10_packing import OpenBins, pack_documents, pieces_of
from newsfunnel.llm.tokens import ByteBpe

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def norm(t):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = norm(t)
        for j in range(max(1, len(w) - 9)):
            if w:
                wins.setdefault(tuple(w[j:j + 10]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = norm(t), set(), set()
        for j in range(len(w)):
            for k in range(1, 11):
                if j + k <= len(w) and (owners := wins.get(tuple(w[j:j + k]))):
                    hit |= set(range(j, j + k))
                    found |= owners
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def bench():
    rng = random.Random(8)
    vocab = ["Alpha", "beta", "ñandú", "x1", "ÉTÉ", "gamma", "d'or", "語"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 9, 10, 14, 30])))) for i in range(12)]
    items += [(50, None), (51, "  ...  "), (52, items[3][1])]
    docs = []
    for d in range(60):
        w = [rng.choice(vocab + ["filler", "noise,"]) for _ in range(rng.randrange(0, 80))]
        if d % 3 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(items)[1:][0].split() if d % 2 else (items[5][1] or "").upper().split()
        docs.append((d, "  ".join(w)))
    docs += [(100, None), (101, ""), (102, "--"), (0, items[4][1])]
    return docs, items


@pytest.mark.parametrize("max_chars", [300, 3_000_000])
def test_decontamination_equals_brute_force(spark, bench, max_chars):
    docs, items = bench
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in docs], "doc_id long, text string, items string, n_words long")
    got = find_contamination(df, spark.createDataFrame(items, "item_id long, text string"), max_chars=max_chars).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["item_ids"])) for r in got), key=str) == brute(docs, items)
    for r in got:
        texts = [t for d, t in docs if d == r["doc_id"]]
        for s in r["spans"]:
            assert any(norm((t or "")[s["start"]:s["end"]]) for t in texts)
        if len(texts) == 1:
            assert sum(len(norm(texts[0][s["start"]:s["end"]])) for s in r["spans"]) == r["n_hit"]


def test_empty_benchmark_leaves_all_clean(spark):
    df = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    got = find_contamination(df, spark.createDataFrame([], "item_id long, text string")).collect()
    assert [(r["n_words"], r["n_hit"]) for r in got] == [(2, 0)]


def test_cascade_is_exact_over_its_universe(spark):
    rng = random.Random(4)
    keys = [f"k{i}" for i in range(4000)]
    listed = rng.sample(keys, 300)
    frame = lambda ks: spark.createDataFrame([(k,) for k in ks], "key string")
    cascade = build_cascade(frame(listed), frame(keys))
    assert len(cascade.levels) > 1
    got = {r["key"] for r in frame(keys).filter(cascade.has(F.col("key"))).collect()}
    assert got == set(listed)
    assert build_cascade(frame(listed), frame(keys), max_bits=64) is None


URLS = [
    "http://a.net/", "http://a.net", "HTTP://A.B.NET/x?y#z", "https://example.net/en/a", "https://x.example.net/en/",
    "https://x.example.net/EN/", "http://example.com/de/1", "http://badexample.com/de/1", "http://example.com/den",
    "http://w.org/fr/x#/y", "http://org/fr/", "http://net/", "http://net?x=/", "no scheme", "", None, "x://", "a://b://c.net/",
    "http://user@h.net:80/p", "http://a.net/\n/en/", "http://.net/",
]


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for rule, verdict in (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")):
        rh, _, rp = rule.partition("/")
        if (host == rh or host.endswith("." + rh)) and path.startswith("/" + rp):
            best = max(best or ("", ""), (rule, verdict), key=lambda x: len(x[0]))
    return (host, path, *(best or (None, "allow")))


@pytest.mark.parametrize("max_bits", [64, 1 << 23])
def test_url_rules_equal_brute_force(spark, max_bits):
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate([*URLS, *URLS])],
                                  "page_id long, url string, html string, key string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"])
           for r in filter_urls(pages, max_bits=max_bits if max_bits > 64 else 1).collect()}
    assert got == {i: judge(u) for i, u in enumerate([*URLS, *URLS])}
    assert filter_urls(pages.limit(0)).collect() == []


def test_bins_take_the_best_fit_and_close_the_fullest():
    bins = OpenBins(10, 2, 0)
    assert [bins.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert bins.count == 0
    assert [bins.place(n) for n in (6, 8, 9, 4, 1)] == [(2, 0), (3, 0), (4, 0), (2, 6), (4, 9)]
    assert list(pieces_of(b"\0" * 4 * 23, 10)) == [(0, 3), (3, 10), (13, 10)]
    assert list(pieces_of(b"\0" * 4 * 20, 10)) == [(0, 10), (10, 10)]


def test_packing_places_every_token_once(spark):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    texts = [" ".join(rng.choice(["the", "naïve", "x" * 9, "<|endoftext|>", "\n\n", "  ", "12,5"]) for _ in range(rng.randrange(0, 900)))
             for _ in range(60)]
    texts += [None, "", " ", "word " * 9000, "trailing ", "a\u00a0b\u2003c \x1cd", "ab" * 5000]
    df = spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)] + [(None, "null id", "f")],
                               "doc_id long, text string, bin string").repartition(5)
    got = pack_documents(df, capacity=512, open_bins=8).toPandas()
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in enumerate(texts):
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        mine = got[got.doc_id == i].sort_values("piece")
        assert mine.length.sum() == len(ids) and list(mine.piece) == list(range(len(mine)))
        assert (mine.length.iloc[1:] == 512).all()
        for r in mine.itertuples():
            assert zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
    assert got.doc_id.isna().sum() == 1
    placed = got.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id").length.cumsum() - placed.length == placed.offset).all()
    assert placed.groupby("sequence_id").length.sum().max() <= 512
    assert got.sequence_id.nunique() <= 1.15 * got.length.sum() / 512 + 1
    assert pack_documents(df.limit(0)).count() == 0


def test_cached_pieces_give_the_ids_of_the_whole_text():
    bpe = ByteBpe()
    for t in ["a  b", " a", "a ", "a\n b", "a \n b", "x\u2003 y", "don't we'll", "¿qué? ñ", "<|endoftext|>a <|endoftext|>", "\x1c a b"]:
        assert list(np.frombuffer(bpe.packed(t), dtype="<u4")) == bpe.encode(t)

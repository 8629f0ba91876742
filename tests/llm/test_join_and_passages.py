"""N-gram Jaccard join and substring dedup against brute force and planted cases."""

import os
import random
import re

import numpy as np
import pytest

from newsfunnel.llm.op1_ngram_join import jaccard_components
from newsfunnel.llm.op9_substring import (
    align, blocks_of, chains_of, extent, passage_spans, repeated_passages, segments, winnow, without_copies,
)
from newsfunnel.llm.shingles import prefix_length
from newsfunnel.session import StageStore, stage_store

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, tok string"


def rows_of(texts):
    return [(i, t, "en", "s", len(t or ""), 7, "x") for i, t in texts]


def words(rng, n, vocab=400):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


def brute_components(texts):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.fixture(scope="module")
def corpus():
    """Families of near copies of all sizes, a shared passage, short and odd texts."""
    rng = random.Random(5)
    texts, n = [], 0
    passage = words(rng, 60)
    for family in range(6):
        base = words(rng, rng.choice([8, 30, 120, 300]))
        for _ in range(rng.choice([2, 5, 25])):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 40 + 1)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                w = w[rng.randrange(3):]
            texts.append((n, " ".join(w)))
            n += 1
    for _ in range(20):
        texts.append((n, " ".join(words(rng, 40) + passage + words(rng, 40))))
        n += 1
    for t in ["", None, "   ", "one", "One", "one two three", "A b C d", "a B c D", "a b c d e", "same\tsame\nsame"]:
        texts.append((n, t))
        n += 1
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("heavy", [3, 64])
def test_components_equal_brute_force(spark, corpus, heavy):
    got = jaccard_components(spark.createDataFrame(rows_of(corpus), SCHEMA), heavy=heavy).collect()
    want = brute_components(corpus)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len(got) == len(corpus)


def test_join_of_odd_tables(spark):
    empty = jaccard_components(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == []
    rows = rows_of([(None, "a b c d e f"), (5, "a b c d e f"), (5, "x y z u v w"), (3, "x y z u v w"), (9, "q")])
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1)
                 for r in jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect())
    # A null id has no component; the two rows of id 5 are one node and tie 3 to it.
    assert got == [(-1, 2, -1), (3, 2, 3), (5, 2, 3), (5, 2, 3), (9, 1, 9)]


def test_prefix_length_is_sound():
    for n in range(1, 300):
        assert n - prefix_length(n) + 1 == -(-80 * n // 100)


def test_winnowing_finds_every_long_enough_run():
    rng = np.random.default_rng(1)
    for _ in range(50):
        shared = rng.integers(0, 1 << 60, 10).astype(np.uint64)
        a = np.concatenate([rng.integers(0, 1 << 60, 30).astype(np.uint64), shared, rng.integers(0, 1 << 60, 9).astype(np.uint64)])
        b = np.concatenate([rng.integers(0, 1 << 60, 3).astype(np.uint64), shared])
        assert set(a[winnow(a, 10)]) & set(b[winnow(b, 10)])


def test_chains_follow_both_texts_and_align_over_edits():
    x = np.arange(100)
    y = np.concatenate([np.arange(40), [900, 901], np.arange(40, 70), np.arange(72, 100)])  # 2 in, 2 out
    blocks = [[0, 30, 0], [45, 68, 2], [75, 95, 0], [10, 16, 60]]
    best = chains_of(blocks)[0]
    assert best == [[0, 30, 0], [45, 68, 2], [75, 95, 0]]
    start, end, ys, ye, same = align(x, y, [tuple(b) for b in best])
    assert (start, end, ys, ye) == (0, 100, 0, 100) and same == 98
    assert extent(np.array([True] * 5 + [False] * 9 + [True] * 50)) == 5
    assert blocks_of(np.array([1, 5, 9]), np.array([3, 7, 30]), 6) == [[1, 11, 2], [9, 15, 21]]


def planted(rng):
    clean = [(i, " ".join(words(rng, 150, 100_000))) for i in range(40)]
    passage = words(rng, 60, 100_000)
    fuzzy = list(passage)
    fuzzy[20], fuzzy[41] = "changed", "altered words"
    docs = dict(clean)
    hosts = {}
    for i, p in zip((100, 101, 102), (passage, passage, fuzzy)):
        before = words(rng, 80, 100_000)
        docs[i] = " ".join(before + p + words(rng, 80, 100_000))
        hosts[i] = (80, 80 + len(" ".join(p).split()))
    docs[200] = None
    docs[201] = ""
    docs[202] = "too short"
    return docs, hosts


def test_planted_passages_are_found_and_clean_texts_left_alone(spark):
    docs, hosts = planted(random.Random(2))
    df = spark.createDataFrame(rows_of(list(docs.items()) + [(None, docs[100])]), SCHEMA)
    spans = passage_spans(repeated_passages(df))
    got = {(r["doc_id"], r["copy"]): (r["start_word"], r["end_word"]) for r in spans.collect()}
    assert {d for d, _ in got} == set(hosts)
    for i, (a, b) in hosts.items():
        start, end = got[(i, i != 100)]
        assert abs(start - a) <= 2 and abs(end - b) <= 2
    assert (100, True) not in got
    out = {r["doc_id"]: r for r in without_copies(df.filter("doc_id is not null"), spans).collect()}
    assert out[100]["text"] == docs[100] and out[0]["text"] == docs[0]
    assert len(out[101]["text"].split()) == 160 and out[101]["n_chars"] == len(out[101]["text"])
    assert set(out) == set(docs)  # nothing but the copied words goes


def test_passages_of_empty_and_all_copied_tables(spark):
    assert passage_spans(repeated_passages(spark.createDataFrame([], SCHEMA))).collect() == []
    text = " ".join(words(random.Random(3), 90, 100_000))
    df = spark.createDataFrame(rows_of([(1, text), (2, text), (3, text)]), SCHEMA)
    spans = passage_spans(repeated_passages(df))
    assert {(r["doc_id"], r["copy"]) for r in spans.collect()} == {(1, False), (2, True), (2, False), (3, True)}
    assert [r["doc_id"] for r in without_copies(df, spans).collect()] == [1]


def found_of(spark, texts):
    df = spark.createDataFrame(rows_of(texts), SCHEMA)
    return {(r["doc_id"], r["start_word"], r["end_word"], r["copy"]) for r in passage_spans(repeated_passages(df)).collect()}


def test_diagonals_of_repeated_text_keep_their_blocks():
    """Matches of one run stay one block when those of other diagonals lie between them."""
    pos = np.repeat(np.arange(0, 60, 5), 3)
    src = pos + np.tile([0, 31, 62], 12)
    assert blocks_of(pos, src, 6) == [[0, 61, 0], [0, 61, 31], [0, 61, 62]]


def test_two_passages_of_one_chain_are_both_found(spark):
    rng = random.Random(8)
    texts, want = [], set()
    for n, (size, gap) in enumerate([(60, 50), (60, 100), (60, 200), (300, 300)]):
        first, second = words(rng, size, 10**9), words(rng, size, 10**9)
        for i in (2 * n, 2 * n + 1):
            texts.append((i, " ".join(first + words(rng, gap, 10**9) + second)))
            want |= {(i, 0, size, i % 2 == 1), (i, size + gap, 2 * size + gap, i % 2 == 1)}
    assert found_of(spark, texts) == want


def test_segments_leave_no_passage_out():
    rng = np.random.default_rng(4)
    for _ in range(300):
        equal = np.concatenate([rng.random(rng.integers(5, 60)) < rng.choice([0.2, 0.7, 0.85, 1.0]) for _ in range(4)])
        dx, dy = rng.random((2, len(equal))) < 0.95
        dy |= ~dx
        equal &= dx & dy
        got = segments(dx, dy, equal, 30, 0.8)
        used = np.zeros(len(equal), dtype=bool)
        for a, b in got:
            n, m = dx[a:b].sum(), dy[a:b].sum()
            assert n >= 30 and equal[a:b].sum() >= 0.8 * max(n, m) - 1e-6 and not used[a:b].any()
            used[a:b] = True
        for a in np.flatnonzero(equal):  # counted by columns, every range that is a passage meets a found one
            for b in np.flatnonzero(equal) + 1:
                if b > a and dx[a:b].sum() >= 30 and equal[a:b].sum() >= 0.8 * (b - a):
                    assert used[a:b].any()


def test_every_place_of_a_passage_and_the_whole_of_repeated_text(spark):
    rng = random.Random(9)
    passage, unit, short = words(rng, 60, 10**9), words(rng, 31, 10**9), words(rng, 9, 10**9)
    twice = words(rng, 40, 10**9) + passage + words(rng, 100, 10**9) + passage + words(rng, 30, 10**9)
    texts = [(1, " ".join(passage)), (2, " ".join(twice))]
    texts += [(n, " ".join(unit * 100)) for n in (3, 4)]
    texts += [(n, " ".join(short * 50)) for n in (5, 6)]
    texts += [(7, " ".join(words(rng, 20, 10**9) + unit * 5)), (8, " ".join(unit * 2))]
    got = found_of(spark, texts)
    assert {r for r in got if r[0] == 2} == {(2, 40, 100, True), (2, 200, 260, True)}
    assert {r for r in got if r[0] in (3, 4)} == {(3, 0, 3100, False), (4, 0, 3100, True), (4, 0, 3100, False)}
    assert {r for r in got if r[0] in (5, 6)} == {(5, 0, 450, False), (6, 0, 450, True)}
    assert (7, 20, 175, True) in got and (8, 0, 62, True) in got


def test_fragments_in_other_documents_take_no_partner(spark):
    rng = random.Random(10)
    texts, want = [], set()
    for n in range(6):
        passage = words(rng, 60, 10**9)
        for i, p in enumerate([passage[:40], passage[20:], passage, passage, passage[:40], passage[20:]]):
            texts.append((10 * n + i, " ".join(words(rng, 30, 10**9) + p + words(rng, 30, 10**9))))
        want |= {(10 * n + 2, 30, 90, False), (10 * n + 3, 30, 90, True)}
    assert found_of(spark, texts) == want


def test_fragments_one_word_short_of_a_passage_take_no_partner(spark):
    """Every 41 words of a passage stand in the first and the last documents, its 50 words in neither."""
    rng = random.Random(12)
    texts, want = [], set()
    for n, size in enumerate([50, 50, 53, 55, 59, 59]):
        passage = words(rng, size, 10**9)
        parts = [passage[i:i + 49] for i in range(0, size - 49, 4)] + [passage[size - 49:]]
        whole = [passage] * (2 + n % 2)
        for i, p in enumerate([*parts, *whole, *parts]):
            texts.append((100 * n + i, " ".join(words(rng, 30, 10**9) + p + words(rng, 30, 10**9))))
        at = [100 * n + len(parts) + i for i in range(len(whole))]
        want |= {(i, 30, 30 + size, False) for i in at[:-1]} | {(i, 30, 30 + size, True) for i in at[1:]}
    assert found_of(spark, texts) == want


def test_rows_that_share_an_id_are_searched_and_cut(spark):
    rng = random.Random(11)
    one, two, fresh = (words(rng, 80, 10**9) for _ in range(3))
    long = words(rng, 30, 10**9) + one + words(rng, 30, 10**9)
    second = words(rng, 25, 10**9) + two
    rows = [(1, " ".join(one)), (1, " ".join(one)), (2, " ".join(long)), (3, " ".join(fresh)), (3, " ".join(second)),
            (3, " ".join(second)), (4, " ".join(two + fresh)), (None, " ".join(one)), (5, None), (5, "")]
    df = spark.createDataFrame(rows_of(rows), SCHEMA)
    spans = passage_spans(repeated_passages(df))
    got = {(r["doc_id"], r["start_word"], r["end_word"], r["copy"], r["text_key"] is None) for r in spans.collect()}
    assert got == {(1, 0, 80, False, False), (2, 30, 110, True, True), (3, 0, 80, False, False), (3, 25, 105, False, False),
                   (4, 0, 160, True, True)}
    kept = sorted((r["doc_id"], " ".join(r["text"].split())) for r in without_copies(df.filter("text != '' and doc_id > 0"), spans).collect())
    assert kept == sorted([*rows[:2], (2, " ".join(long[:30] + long[110:])), *rows[3:6]])
    # Different texts of one id: the first in the order of their keys keeps what they share.
    df = spark.createDataFrame(rows_of([(7, " ".join(one + fresh[:20])), (7, " ".join(fresh[30:60] + one))]), SCHEMA)
    spans = passage_spans(repeated_passages(df))
    assert sorted((r["doc_id"], r["other_doc_id"], r["copy"]) for r in spans.collect()) == [(7, 7, False), (7, 7, True)]
    assert sorted(len(r["text"].split()) for r in without_copies(df, spans).collect()) in ([20, 110], [30, 100])


def test_tables_of_the_search_go_when_they_are_read(spark):
    store = StageStore(spark)
    words = [f"w{i}" for i in range(200)]
    with stage_store(store):
        found = repeated_passages(spark.createDataFrame(
            [(1, " ".join(words), "en"), (2, " ".join(["x", *words, "y"]), "en")], "doc_id long, text string, lang string"))
    kept = os.listdir(store.path.removeprefix("file:"))
    assert not [k for k in kept if k.startswith(("seeds", "met", "search", "cut"))]
    assert {(r["doc_id"], r["start"], r["end"]) for r in found.collect()} == {(1, 0, 200), (2, 1, 201)}
    store.release()

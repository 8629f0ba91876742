"""Similarity joins, components and identity merge against brute force."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsfunnel.operators import clusters, components, cosine, merge, titles
from newsfunnel.operators.numbering import with_ordinal

from tests import brute


def as_map(df):
    return {r["node"]: r["component"] for r in df.collect()}


def linked_groups(spark, edges_df):
    return as_map(components.connected_components(edges_df))


def expected_groups(nodes, edges):
    """Only nodes that have an edge."""
    touched = {n for e in edges for n in e}
    return {n: r for n, r in brute.groups(nodes, edges).items() if n in touched}


def test_components_chain_star_and_loops(spark):
    rng = random.Random(1)
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    star = [("hub", f"s{i:04d}") for i in range(500)]
    rand = [(f"r{rng.randrange(80):02d}", f"r{rng.randrange(80):02d}") for _ in range(60)]
    edges = chain + star + rand + [("lone", "lone")]
    got = linked_groups(spark, spark.createDataFrame(edges, "a string, b string"))
    proper = [(a, b) for a, b in edges if a != b]
    assert got == expected_groups({n for e in proper for n in e}, proper)


def test_components_by_contraction(spark, monkeypatch):
    """The same groups, and finished components are not written again in every round."""
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 300)]
    edges += [(rng.randrange(2000, 2600), rng.randrange(2000, 2600)) for _ in range(400)]
    edges += [(3000 + 2 * i, 3001 + 2 * i) for i in range(300)]
    monkeypatch.setattr(components, "CONTRACT_ABOVE", 20)
    sizes, stored = [], components._stored
    monkeypatch.setattr(components, "_stored", lambda e: (lambda out: (sizes.append(out[2]["n"]), out)[1])(stored(e)))
    got = linked_groups(spark, spark.createDataFrame(edges, "a bigint, b bigint"))
    proper = [e for e in edges if e[0] != e[1]]
    assert got == expected_groups({n for e in proper for n in e}, proper)
    assert sum(sizes[1:]) < 2 * sizes[0]


def test_components_of_nothing(spark):
    assert components.connected_components(
        spark.createDataFrame([], "a string, b string")).count() == 0


def variants(rng, base, n):
    out = []
    for _ in range(n):
        s = list(base)
        for _ in range(rng.randrange(0, 4)):
            i = rng.randrange(len(s))
            op = rng.choice("irs")
            if op == "i":
                s.insert(i, rng.choice("abcdefgh"))
            elif op == "r" and len(s) > 3:
                del s[i]
            else:
                s[i] = rng.choice("abcdefgh")
        out.append("".join(s))
    return out


@pytest.mark.parametrize("ratio", [95, 90])
def test_title_join_is_exact(spark, ratio):
    rng = random.Random(7)
    bases = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (17, 19, 25, 40, 70, 120)]
    texts = [t for b in bases for t in variants(rng, b, 25)] + ["", "!!", "Ü", "b a", "a b", "a  B"]
    rows = [(f"t{i:04d}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, title string")
    first = {}
    for i, t in rows:
        first.setdefault(brute.norm_title(t), i)
    reps = {i: t for t, i in first.items() if t}
    want = {
        (a, b): brute.title_ratio(reps[a], reps[b])
        for a, b in itertools.combinations(sorted(reps), 2)
        if brute.title_ratio(reps[a], reps[b]) >= ratio
    }
    got = {(r["a"], r["b"]): r["ratio"] for r in titles.title_pairs(df, ratio).collect()}
    assert got == want
    assert len(want) > 100
    copies = [(first[brute.norm_title(t)], i) for i, t in rows if brute.norm_title(t)]
    edges = list(want) + [e for e in copies if e[0] != e[1]]
    links = titles.title_links(df, ratio)
    assert linked_groups(spark, links) == expected_groups([i for i, _ in rows], edges)


def test_title_links_stay_linear_in_near_copies(spark):
    """A third of the titles are near copies of one headline; another third exact copies."""
    rng = random.Random(3)
    base = "quarterly report of the regional dairy association on milk prices and yields "
    near = [(f"n{i:04d}", base + f"{i:03d}") for i in range(300)]
    same = [(f"s{i:04d}", "the very same headline again") for i in range(300)]
    rest = [(f"r{i:04d}", "".join(rng.choice("abcdefghijk ") for _ in range(60)))
            for i in range(300)]
    df = spark.createDataFrame(near + same + rest, "id string, title string")
    links = titles.title_links(df)
    assert links.count() < 5 * 900
    got = linked_groups(spark, links)
    assert len({got[i] for i, _ in near}) == 1
    assert len({got[i] for i, _ in same}) == 1
    assert not any(i in got for i, _ in rest)


def test_title_links_unite_no_two_joins_of_the_same_rows(spark):
    """Spark 4.1 zips the sides of such a union, which failed at 0.1 GB when one join was split."""
    df = spark.createDataFrame([("a", "one title of some length"), ("b", "one title of some lengths")], "id string, title string")
    plan = titles.title_links(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "LeftSemi" not in plan


def test_titles_of_one_vocabulary_are_told_apart_by_letters(spark, monkeypatch):
    """Titles that share their grams but not their letters are not measured against each other."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(60)]
    rows = [(f"t{i:04d}", " ".join(rng.choices(words, k=40))) for i in range(200)]
    met, cut = {}, titles.cut_lineage

    def seen(df, label="stage"):
        out = cut(df, label)
        met[label] = out.count()
        return out

    monkeypatch.setattr(titles, "cut_lineage", seen)
    titles.title_pairs(spark.createDataFrame(rows, "id string, title string"))
    assert met["near"] < 2000  # of 19,900 pairs


def test_a_family_is_not_compared_again_in_a_gram_of_a_foreign_pivot(spark, monkeypatch):
    """The smallest title shares most grams of 300 near copies and matches none of them."""
    halves = "quarterly report of the regional dairy ", "association on milk prices and yields "
    rows = [("a0000", halves[1] + halves[0] + "zero")]
    rows += [(f"n{i:04d}", "zq " + "".join(halves) + f"{i:03d}") for i in range(300)]
    met, cut = [], titles.cut_lineage

    def seen(df, label="stage"):
        out = cut(df, label)
        if label == "near":
            met.append(out.count())
        return out

    monkeypatch.setattr(titles, "cut_lineage", seen)
    got = linked_groups(spark, titles.title_links(spark.createDataFrame(rows, "id string, title string")))
    assert got == {i: "n0000" for i, _ in rows[1:]}
    assert sum(met) < 5 * 300


@pytest.mark.parametrize("width", [3, 6])
def test_enough_grams_outlast_the_edits(width):
    rng = random.Random(width)
    for _ in range(300):
        begins = rng.sample(range(60), rng.randrange(1, 50))
        edits = rng.randrange(1, 6)

        def needed(some):  # the fewest letters that touch every gram
            return next(k for k in range(len(some) + 1) if covers(sorted(some), k))

        def covers(some, k):
            return not some or (k > 0 and covers([b for b in some if b > some[0] + width - 1], k - 1))

        n = titles._enough(begins, width, edits)
        assert n == len(begins) or needed(begins[:n]) > edits
        assert n <= width * edits + 1 and (n == 1 or needed(begins[:n - 1]) <= edits)


def vectors(spark, mat, kind="float"):
    rows = [(f"v{i:04d}", [float(x) for x in v]) for i, v in enumerate(mat)]
    return spark.createDataFrame(rows, f"id string, embedding array<{kind}>")


def test_a_crowded_cell_is_cut_into_equal_keys(spark, monkeypatch):
    """The largest join key has as many tile pairs whether its cell has few tiles or many."""
    monkeypatch.setattr(cosine, "BLOCK_TILES", 4)
    for n in (8, 96):
        tiles = spark.range(n).select(
            F.format_string("t%04d", "id").alias("tile"), F.lit(0).alias("cell"), F.lit(cosine._HOME).alias("role"),
            F.array(F.lit("x")).alias("ids"), F.array(F.lit(1)).alias("weights"), F.lit(b"").alias("mat"))
        pairs = cosine._tile_pairs(tiles, skip_balls=False)
        met = pairs.groupBy("cell", "row", "column").count().agg(F.max("count"), F.sum("count")).first()
        assert met[1] == n * (n + 1) // 2 and met[0] <= 144


def test_single_precision_leaves_no_cosine_open():
    """Cosines a hair from the threshold, on either side, are decided in double precision."""
    rng = np.random.default_rng(11)
    left = rng.normal(size=(70, 64))
    left /= np.linalg.norm(left, axis=1, keepdims=True)
    side = rng.normal(size=(70, 64))
    side -= (side * left).sum(axis=1, keepdims=True) * left
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = 0.4 + np.linspace(-1e-7, 1e-7, 70)[:, None]
    right = cos * left + np.sqrt(1 - cos ** 2) * side
    assert (cosine._reaching(0.4)(left, right) == (left @ right.T >= 0.4)).all()


def test_links_move_a_vector_in_fewer_tile_pairs(spark, monkeypatch):
    """2,000 vectors of one cell are a few tile pairs for links, not 36."""
    rng = np.random.default_rng(12)
    seen, products = [], cosine._products

    def count(pairs, *rest):
        seen.append(pairs.count())
        return products(pairs, *rest)

    monkeypatch.setattr(cosine, "_products", count)
    cosine.cosine_links(vectors(spark, rng.normal(size=(2000, 16))), 0.9, n_cells=1).count()
    assert seen[0] <= 15


@pytest.mark.parametrize("n_cells", [1, 7])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_cosine_join_is_exact(spark, n_cells, kind):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24))
    mat = np.vstack([c + rng.normal(scale=s, size=(60, 24)) for c, s in zip(
        centres, np.linspace(0.05, 0.8, 12))]).astype(np.float32)
    mat = np.vstack([mat, mat[:30], np.zeros((2, 24), np.float32)])
    df = vectors(spark, mat, kind)
    unit = mat[:720].astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    sims = unit @ unit.T
    want = {(f"v{i:04d}", f"v{j:04d}"): sims[i, j]
            for i, j in zip(*np.nonzero(np.triu(sims >= 0.8, 1)))}
    rows = cosine.cosine_pairs(df, 0.8, n_cells=n_cells).collect()
    got = {(r["a"], r["b"]): r["sim"] for r in rows}
    assert len(rows) == len(got)
    assert set(got) == set(want)
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9
    links = cosine.cosine_links(df, 0.8, n_cells=n_cells)
    copies = [(f"v{i:04d}", f"v{i + 720:04d}") for i in range(30)]
    nodes = [f"v{i:04d}" for i in range(len(mat))]
    assert linked_groups(spark, links) == expected_groups(nodes, list(want) + copies)
    counted = {r["threshold"]: r["pairs"] for r in cosine.pair_counts(
        df, [0.8, 0.95], n_cells=n_cells).collect()}
    full = mat[:750].astype(np.float64)
    full /= np.linalg.norm(full, axis=1, keepdims=True)
    every = full @ full.T
    for t in (0.8, 0.95):
        assert counted[t] == int((np.triu(every >= t - 1e-12, 1)).sum())
    top = [(r["a"], r["b"]) for r in cosine.top_pairs(df, 0.8, 0.9, 10, n_cells=n_cells).collect()]
    best = sorted((k for k in want if want[k] < 0.9), key=lambda k: (-want[k], k))[:10]
    assert top == best


def pairs_of_rows(rows, low, high=9.0):
    """What the SQL of similar_pairs gives: every two rows with different ids."""
    out = []
    for n, (a, x) in enumerate(rows):
        for b, y in rows[n + 1:]:
            if a is None or b is None or a == b or not any(x) or not any(y):
                continue
            sim = 1.0 if x == y else float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))
            if low <= sim < high:
                out.append((min(a, b), max(a, b), round(sim, 6)))
    return sorted(out, key=lambda r: (-r[2], r[0], r[1]))


def rows_with_copies():
    """Vectors that several ids have, rows that come twice, ids with two vectors, null ids, zeros."""
    rng = np.random.default_rng(15)
    base = [[float(v) for v in row] for row in rng.normal(size=(40, 6))]
    rows = [(f"v{i:03d}", v) for i, v in enumerate(base)]
    rows += [(f"c{i:03d}", base[i % 7]) for i in range(20)] + [rows[3], rows[3], rows[12], rows[13]]
    rows += [("v001", base[20]), ("c001", base[2]), ("x", base[30]), ("x", base[31]), ("x", base[30])]
    rows += [(None, base[5]), (None, base[33]), ("z", [0.0] * 6)]
    return rows


@pytest.mark.parametrize("n_cells", [1, 5])
def test_pairs_of_rows_with_equal_vectors_are_reported(spark, n_cells):
    rows = rows_with_copies()
    df = spark.createDataFrame(rows, "id string, embedding array<double>")
    got = cosine.cosine_pairs(df, 0.4, n_cells=n_cells, copies=True).collect()
    want = pairs_of_rows(rows, 0.4)
    assert sorted((r["a"], r["b"], round(r["sim"], 6)) for r in got) == sorted(want)
    alone = cosine.cosine_pairs(df.filter("id like 'v%'").dropDuplicates(["embedding"]), 0.4, n_cells=n_cells, copies=True)
    assert alone.filter("a >= b").count() == 0
    none = df.filter("id = 'z' or id is null")
    assert cosine.cosine_pairs(none, 0.4, n_cells=n_cells, copies=True).collect() == []


@pytest.mark.parametrize("n", [1, 6, 40])
@pytest.mark.parametrize("low,high", [(0.25, 0.6), (0.5, 1.5)])
def test_top_pairs_count_rows_with_equal_vectors(spark, n, low, high):
    rows = rows_with_copies()
    df = spark.createDataFrame(rows, "id string, embedding array<double>")
    got = cosine.top_pairs(df, low, high, n, n_cells=3, copies=True).collect()
    assert [(r["a"], r["b"], round(r["sim"], 6)) for r in got] == pairs_of_rows(rows, low, high)[:n]


@pytest.mark.parametrize("name", ["similar_pairs", "top_pairs", "similarity_band", "top_pairs_with_titles"])
def test_pair_queries_report_every_row_of_a_vector(spark, tmp_path, name):
    """Two ids of one vector pair with each other and each of them with the rest, as in the SQL."""
    from checks import catalog

    rng = np.random.default_rng(16)
    base = [[float(v) for v in row] for row in rng.normal(size=(30, 4))]
    vecs = [(i, v, 0) for i, v in enumerate(base)] + [(100 + i, v, 0) for i, v in enumerate(base[:10])]
    spark.createDataFrame(vecs, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, f"t{i}", "en", "s", 2) for i, _, _ in vecs], "doc_id long, text string, lang string, "
                          "source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    low, high, most = {"similar_pairs": (0.4, 9.0, None), "similarity_band": (0.35, 0.45, None)}.get(name, (0.25, 0.45, 22))
    def key(i):
        return f"a{i:0>10}" if name == "top_pairs_with_titles" else i
    want = pairs_of_rows([(str(i), v) for i, v, _ in vecs], low, high)[:most]
    got = catalog.QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted((r["a"], r["b"], r["sim"]) for r in got) == sorted((key(a), key(b), s) for a, b, s in want)


def test_cosine_links_stay_linear_in_near_copies(spark):
    rng = np.random.default_rng(9)
    near = rng.normal(size=(1, 16)) + rng.normal(scale=0.01, size=(700, 16))
    mat = np.vstack([near, rng.normal(size=(200, 16))])
    links = cosine.cosine_links(vectors(spark, mat, "double"), 0.9, n_cells=4)
    assert links.count() < 4 * 900
    got = linked_groups(spark, links)
    assert len({got[f"v{i:04d}"] for i in range(700)}) == 1


def test_cosine_rejects_mixed_widths(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0])], "id string, embedding array<double>")
    with pytest.raises(ValueError, match="length mismatch"):
        cosine.cosine_pairs(df)


DEAL = ("deal_id string, cluster_id string, acquirer string, target string, deal_type string, "
        "deal_value double, currency string, stake_pct double, announced_date timestamp, "
        "feed_pos bigint")


def random_deals(seed, n, tight):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    out = []
    for i in range(n):
        value = rng.choice([None, 1.0, 100.0, 100.9, 101.0, 101.5, 102.0, 99.1, 98.2, 250.0])
        if tight and value:
            value = round(100 * 1.0035 ** rng.randrange(0, 12), 4)
        days = rng.uniform(0, 40) if tight else rng.choice([0, 1, 4, 5, 5.5, 6, 9, 10, 11, 30])
        out.append({
            "deal_id": f"d{i:04d}", "cluster_id": f"d{i:04d}",
            "acquirer": rng.choice(["Undisclosed", " undisclosed ", "", "Harrowby", "Harrowby Ltd",
                                    "Marico", "The Company", "Marico Harrowby"]),
            "target": rng.choice(["Zolvia, BrightHull", "Zolvia", "BrightHull Labs", "Corvane",
                                  "Corvane Zolvia", "Foods Group"]),
            "deal_type": rng.choice(["M&A", "Stake"]),
            "deal_value": value,
            "currency": rng.choice(["INR", "USD"]) if value else None,
            "stake_pct": rng.choice([None, None, 51.0, 100.0]),
            "announced_date": start + dt.timedelta(days=days),
            "feed_pos": i,
        })
    return out


@pytest.mark.parametrize("seed,n,tight", [(1, 60, False), (2, 120, True), (3, 35, True),
                                          (4, 25, False), (5, 250, True)])
def test_same_deal_links_match_brute_force(spark, seed, n, tight):
    deals = random_deals(seed, n, tight)
    pairs = [(x["deal_id"], y["deal_id"]) for x, y in itertools.combinations(deals, 2)
             if brute.same_deal(x, y)]
    df = spark.createDataFrame([tuple(d.values()) for d in deals], DEAL)
    links = merge.same_deal_links(df)
    assert {(r["a"], r["b"]) for r in links.collect()} <= set(pairs)
    assert linked_groups(spark, links) == expected_groups(
        [d["deal_id"] for d in deals], pairs)


def test_same_deal_links_stay_linear_under_skew(spark):
    """A third of all records: one buyer, one target, one week."""
    deals = random_deals(8, 1200, True)
    for d in deals[:400]:
        d.update(acquirer="Harrowby", target="Zolvia", deal_type="M&A", deal_value=None,
                 currency=None, announced_date=dt.datetime(2024, 1, 1) + dt.timedelta(
                     minutes=d["feed_pos"]))
    links = merge.same_deal_links(spark.createDataFrame([tuple(d.values()) for d in deals], DEAL))
    assert links.count() < 12 * 1200


def test_merge_prefers_information_and_enriches(spark):
    day = dt.datetime(2026, 7, 16)
    rows = [
        ("d1", "d1", "Undisclosed", "Quenta Cosmetics", "Funding", 100.0, "INR_CRORE", None, day, 1),
        ("d2", "d2", "Ostwind", "Quenta", "Funding", 100.0, "INR_CRORE", None, day, 2),
        ("d3", "d3", "Undisclosed", "Quenta Cosmetics", "Funding", 100.0, "INR_CRORE", 10.0,
         day, 3),
        ("d4", "d4", "Lumenfold", "Brightbrook Hollis Company", "Stake", None, None, None, day, 4),
        ("d5", "d5", "Ironvale", "Brightbrook Hollis Company", "Stake", None, None, None, day, 5),
    ]
    deals = spark.createDataFrame(rows, DEAL)
    membership = spark.createDataFrame(
        [("d1", "d1"), ("x1", "d1"), ("d2", "d2"), ("d4", "d4")],
        "article_id string, cluster_id string")
    sizes = membership.groupBy("cluster_id").agg(F.count("*").alias("size"))
    merged, members = merge.merge_deals(deals, merge.same_deal_links(deals), membership, sizes)
    got = {r["deal_id"]: r for r in merged.collect()}
    assert set(got) == {"d2", "d4", "d5"}
    assert got["d2"]["merged"] == 2 and got["d2"]["stake_pct"] == 10.0
    assert {(r["article_id"], r["cluster_id"]) for r in members.collect()} == {
        ("d1", "d2"), ("x1", "d2"), ("d2", "d2"), ("d3", "d2"), ("d4", "d4"), ("d5", "d5")}


def test_cluster_order_does_not_matter(spark):
    """Components do not depend on row order, and ties go by tier, date and arrival."""
    ts = dt.datetime(2024, 1, 1)
    rows = [("a", "same words here", "s", 3, ts, 1), ("b", "words here same", "s", 1, ts, 2),
            ("c", "here same words", "s", 1, ts, 3), ("d", "other", "s", 2, ts, 4)]
    ddl = "id string, title string, source string, source_tier int, published_at timestamp, feed_pos bigint"
    results = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, ddl)
        membership, rows_out = clusters.build_clusters(df, clusters.story_links(df, None))
        results.add((
            tuple(sorted((r["article_id"], r["cluster_id"]) for r in membership.collect())),
            tuple(sorted((r["cluster_id"], r["size"]) for r in rows_out.collect()))))
    assert results == {((("a", "b"), ("b", "b"), ("c", "b"), ("d", "d")), (("b", 3), ("d", 1)))}


def test_ordinal_is_global_and_dense(spark):
    df = spark.range(0, 5000, 1, 7).select(((F.col("id") * 7919) % 5000).alias("k"))
    out = with_ordinal(df, [F.asc("k")]).collect()
    assert all(r["k"] == r["ordinal"] for r in out) and len(out) == 5000

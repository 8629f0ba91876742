"""Cosine similarity join over embedding vectors, exact.

Equal vectors are folded first; joins that report rows unfold them where pairs are found. The others are placed in the cell of their nearest pivot
(pivots: a bounded hash sample of the data) and copied to a lower-numbered cell only when the
plane between the two pivots is closer than the distance that the threshold allows; so every
similar pair meets in exactly one cell, and well-separated topics never meet. Inside a cell,
vectors travel as tiles of bounded size, and each tile pair is one matrix product.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import FloatType

from newsfunnel import dims
from newsfunnel.session import cut_lineage, map_batches

TILE_ROWS = 256
LINK_TILE_ROWS = 1024  # links are few and told from yes and no, so larger tiles fit and cost less to move
BLOCK_TILES = 16
MAX_CELLS = 256
CELL_ROWS = 20_000
_SLACK = 1e-9  # keeps float rounding on the safe side of every bound

_BALL, _HOME, _GUEST = 0, 1, 2


def _rows(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    return df.select(F.col(id_col).cast("string").alias("id"), F.col(vec).alias("vec")).filter(
        F.exists("vec", lambda x: x != 0)
    )


def fold_vectors(df: DataFrame, id_col: str, vec: str):
    """(reps, copies): one (id, vec, weight) per distinct non-zero vector, and star edges."""
    base = _rows(df, id_col, vec)
    reps = base.groupBy("vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    copies = (
        base.join(reps, "vec").filter(F.col("id") != F.col("rep"))
        .select(F.col("rep").alias("a"), F.col("id").alias("b"))
    )
    return reps.select(F.col("rep").alias("id"), "vec", "weight"), copies


def _fold_rows(base: DataFrame) -> DataFrame:
    """(id, vec, weight), one per distinct vector, to be stored: its name is its id behind "=", with
    the number of its rows as weight, or, if several ids have it, a number behind "*"."""
    alone = F.col("low") == F.col("high")
    return base.groupBy("vec").agg(
        F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")
    ).select(
        F.when(alone, F.concat(F.lit("="), "low")).otherwise(
            F.concat(F.lit("*"), F.monotonically_increasing_id().cast("string"))).alias("id"),
        "vec", F.when(alone, F.col("n")).otherwise(F.lit(1).cast("bigint")).alias("weight"))


def _unit(rows) -> np.ndarray:
    mat = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    return mat / np.linalg.norm(mat, axis=1, keepdims=True)


def _pivots(reps: DataFrame, n_cells: int, ball_floor: float) -> np.ndarray:
    """Unit vectors of at most n_cells rows, none inside the ball of an earlier one, so that a
    family of near copies gets one pivot however large it is."""
    sample = reps.orderBy(F.xxhash64("id"), "id").limit(n_cells).select("vec").collect()
    kept: list[np.ndarray] = []
    for vec in _unit([r["vec"] for r in sample]):
        if all(vec @ k < ball_floor for k in kept):
            kept.append(vec)
    return np.stack(kept)


def _place(reps: DataFrame, threshold: float, n_cells: int) -> DataFrame:
    """(id, contact, vec, weight, cell, role) with one row per cell a vector must appear in.

    `contact` names a vector for linking: its own id, or the mark of its ball.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + _SLACK
    ball_floor = math.sqrt((1 + threshold) / 2) + 1e-7
    pivots = _pivots(reps, n_cells, ball_floor)
    gaps = np.linalg.norm(pivots[:, None, :] - pivots[None, :, :], axis=2)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            sims = _unit(batch["vec"]) @ pivots.T
            home = sims.argmax(axis=1)
            best = sims[np.arange(len(home)), home]
            margin = best[:, None] - sims
            near = margin <= reach * gaps[home] + _SLACK
            guests = [
                np.flatnonzero(row[:h]).astype(np.int32) for row, h in zip(near, home)
            ]
            yield batch.assign(
                home=home.astype(np.int32), ball=best >= ball_floor, guests=guests
            )

    vec_type = reps.schema["vec"].dataType.simpleString()
    placed = map_batches(
        reps, place,
        f"id string, vec {vec_type}, weight bigint, home int, ball boolean, guests array<int>",
    )
    own = F.struct(
        F.col("home").alias("cell"),
        F.when(F.col("ball"), F.lit(_BALL)).otherwise(F.lit(_HOME)).alias("role"),
    )
    away = F.transform(
        "guests", lambda c: F.struct(c.alias("cell"), F.lit(_GUEST).alias("role"))
    )
    stops = F.concat(F.array(own), away)
    contact = F.when(F.col("ball"), ball_mark(F.col("home"))).otherwise(F.col("id"))
    return placed.select(
        "id", contact.alias("contact"), "vec", "weight", F.explode(stops).alias("at")
    ).select("id", "contact", "vec", "weight", "at.cell", "at.role")


def ball_mark(cell: Column) -> Column:
    return F.concat(F.lit("\u0001"), cell.cast("string"))


def _tiles(placed: DataFrame, n_rows: int, n_cells: int, tile_rows: int) -> DataFrame:
    """Pack rows of one cell and role into tiles of at most `tile_rows` vectors."""
    dtype = np.float32 if isinstance(
        placed.schema["vec"].dataType.elementType, FloatType) else np.float64
    salts = max(1, math.ceil(n_rows / (n_cells * tile_rows * 4)))

    def tile(part: int, seq: int, cell: int, role: int, rows: pd.DataFrame) -> tuple:
        mat = np.stack([np.asarray(v, dtype=dtype) for v in rows["vec"]])
        return (
            f"{part:06d}-{seq:08d}", cell, role, rows["id"].tolist(), rows["weight"].tolist(),
            mat.tobytes(),
        )

    names = ["tile", "cell", "role", "ids", "weights", "mat"]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, open_rows = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            rows = batch if open_rows is None else pd.concat([open_rows, batch])
            groups = [(key, g) for key, g in rows.groupby(["cell", "role"], sort=False)]
            done, open_rows = [], None
            for k, ((cell, role), g) in enumerate(groups):
                last = k == len(groups) - 1
                stop = len(g) - len(g) % tile_rows if last else len(g)
                for i in range(0, stop, tile_rows):
                    done.append(tile(part, seq, cell, role, g.iloc[i:min(i + tile_rows, stop)]))
                    seq += 1
                if last and stop < len(g):
                    open_rows = g.iloc[stop:]
            if done:
                yield pd.DataFrame(done, columns=names)
        if open_rows is not None:
            key = (int(open_rows["cell"].iloc[0]), int(open_rows["role"].iloc[0]))
            yield pd.DataFrame([tile(part, seq, *key, open_rows)], columns=names)

    spread = placed.repartition(
        "cell", F.pmod(F.xxhash64("id"), F.lit(salts))
    ).sortWithinPartitions("cell", "role")
    return cut_lineage(map_batches(
        spread, pack,
        "tile string, cell int, role int, ids array<string>, weights array<bigint>, mat binary",
    ))


def _tile_pairs(tiles: DataFrame, skip_balls: bool) -> DataFrame:
    """Home tiles against all tiles of their cell, each unordered pair once.

    Both sides of a cell are dealt to blocks of about BLOCK_TILES tiles, and every two blocks meet
    under a join key of their own: a key is the same work whatever the size of its cell.
    """
    home = F.col("role") != _GUEST
    sizes = tiles.groupBy("cell").agg(  # one row per cell
        F.ceil(F.count(F.when(home, 1)) / BLOCK_TILES).cast("int").alias("rows"),
        F.ceil(F.count(F.lit(1)) / BLOCK_TILES).cast("int").alias("columns"))
    dealt = tiles.join(F.broadcast(sizes), "cell")

    def block(n: str) -> Column:
        return F.pmod(F.xxhash64("tile"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = dealt.filter(home).withColumn("row", block("rows")).withColumn("column", every("columns"))
    right = dealt.filter("rows > 0").withColumn("column", block("columns")).withColumn("row", every("rows"))
    cols = ["tile", "role", "ids", "weights", "mat"]
    key = ["cell", "row", "column"]
    left = left.select(*key, *[F.col(c).alias(f"{c}_l") for c in cols])
    right = right.select(*key, *[F.col(c).alias(f"{c}_r") for c in cols])
    once = (F.col("role_r") == _GUEST) | (F.col("tile_l") <= F.col("tile_r"))
    pairs = left.join(right, key).filter(once)
    if skip_balls:
        pairs = pairs.filter(~((F.col("role_l") == _BALL) & (F.col("role_r") == _BALL)))
    return pairs


def _cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left @ right.T


def _reaching(threshold: float) -> Callable:
    """Which cosines of unit vectors are at least `threshold`: a product in single precision, and in
    double precision the few that its rounding leaves open."""

    def reaches(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        slack = (left.shape[1] + 8) * 2.0 ** -23  # above the rounding of both factors and of the sum
        sims = left.astype(np.float32) @ right.astype(np.float32).T
        hit = sims >= np.float32(threshold - slack)
        i, j = np.nonzero(hit & (sims <= np.float32(threshold + slack)))
        for at in range(0, len(i), 1 << 14):
            k, m = i[at:at + (1 << 14)], j[at:at + (1 << 14)]
            hit[k, m] = np.einsum("ij,ij->i", left[k], right[m]) >= threshold
        return hit

    return reaches


def _products(
    pairs: DataFrame, dtype, width: int, kernel: Callable, schema: str, product: Callable = _cosines,
) -> DataFrame:
    """Run `kernel(sims, row)` on the `product` of every tile pair; cells of a tile with itself
    at or below the diagonal are set to -2, or to false."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                left = _unit(np.frombuffer(row.mat_l, dtype=dtype).reshape(-1, width))
                right = _unit(np.frombuffer(row.mat_r, dtype=dtype).reshape(-1, width))
                sims = product(left, right)
                if row.tile_l == row.tile_r:
                    sims[np.tril_indices(len(sims))] = False if sims.dtype == bool else -2.0
                out = kernel(sims, row)
                if len(out):
                    yield out

    return map_batches(pairs, run, schema)


class _Prepared:
    """Folded, placed and tiled vectors, ready for one kind of product."""

    def __init__(self, df, id_col, vec, threshold, n_cells, skip_balls=False, unfold=False):
        if not 0 < threshold <= 1:
            raise ValueError("threshold must lie in (0, 1]")
        if unfold:
            self.rows = _rows(df, id_col, vec).filter("id is not null")
            reps = _fold_rows(self.rows)
        else:
            reps, self.copies = fold_vectors(df, id_col, vec)
        self.reps = cut_lineage(reps)
        shape = self.reps.agg(
            F.count(F.lit(1)).alias("n"), F.min(F.size("vec")).alias("lo"),
            F.max(F.size("vec")).alias("hi"), F.max("weight").alias("most"),
            F.max(F.col("id").startswith("*")).alias("shared"),
        ).first()
        self.n, self.width = shape["n"], shape["hi"]
        self.repeated, self.shared = (shape["most"] or 1) > 1, unfold and bool(shape["shared"])
        if shape["lo"] != shape["hi"]:
            raise ValueError(f"vector length mismatch: {shape['lo']} vs {shape['hi']}")
        self.dtype = np.float32 if isinstance(
            self.reps.schema["vec"].dataType.elementType, FloatType) else np.float64
        if self.n == 0:
            return
        self.cells = n_cells or min(MAX_CELLS, max(1, math.ceil(self.n / CELL_ROWS)))
        self.cells = min(self.cells, self.n)
        self.placed = _place(self.reps, threshold, self.cells)
        if skip_balls:
            self.placed = cut_lineage(self.placed)
        named = self.placed.withColumn("id", F.col("contact" if skip_balls else "id"))
        self.tiles = _tiles(
            named.drop("contact"), self.n, self.cells, LINK_TILE_ROWS if skip_balls else TILE_ROWS)
        self.pairs = _tile_pairs(self.tiles, skip_balls)

    def run(self, kernel, schema, product=_cosines):
        spark = self.reps.sparkSession
        if self.n == 0:
            return spark.createDataFrame([], schema)
        return _products(self.pairs, self.dtype, self.width, kernel, schema, product)


    def unfolded(self, threshold: float, limit: int | None = None, below: float = 9.0) -> DataFrame:
        """(a, b, sim) of rows with different ids; with `limit` at least the best `limit` of them, by
        cosine, then a, then b."""
        found = self.run(_pair_rows(threshold, limit, below, unfold=True), _WEIGHED)
        if self.n == 0 or not (self.shared or self.repeated):
            return _ordered(found.select(_own("a").alias("a"), _own("b").alias("b"), "sim"))
        if self.shared:
            found = self._with_ids(found, threshold, limit, below)
        else:
            found = found.withColumns({"a": _own("a"), "b": _own("b")})
        for n in ("n_a", "n_b"):  # rows of one id and vector; one side after the other bounds each list
            rows = F.col(n) if limit is None else F.least(n, F.lit(limit))
            found = found.withColumn(n, F.explode(F.sequence(F.lit(1).cast("bigint"), rows)))
        return _ordered(found)

    def _with_ids(self, found: DataFrame, threshold: float, limit: int | None, below: float) -> DataFrame:
        """Pairs of names -> pairs of ids; vectors that several ids have are joined to those, and the
        ids of one vector are pairs too."""
        found = cut_lineage(found, "pairs")
        names = self.reps.filter(F.col("id").startswith("*")).select(F.col("id").alias("name"), "vec")
        members = self.rows.join(names, "vec").groupBy("name", "id").agg(F.count(F.lit(1)).alias("n"))
        if limit is not None:
            last = found.orderBy(F.desc("sim")).limit(limit).agg(F.min("sim")).first()[0]
            found = found.filter(F.lit(last).isNull() | (F.col("sim") >= F.lit(last)))
            # Lower ids come first on either side, and one of them may be the partner's own.
            members = members.withColumn("_rn", F.row_number().over(
                Window.partitionBy("name").orderBy("id"))).filter(F.col("_rn") <= limit + 1).drop("_rn")
        members = cut_lineage(members, "members")
        for side in ("a", "b"):  # an inner join and the rest, so that adaptive execution may split both sides
            many = F.col(side).startswith("*")
            met = found.filter(many).join(members.select(
                F.col("name").alias(side), F.col("id").alias("_id"), F.col("n").alias("_n")), side)
            found = found.filter(~many).withColumn(side, _own(side)).unionByName(
                met.withColumns({side: F.col("_id"), f"n_{side}": F.col("_n")}).drop("_id", "_n"))
        found = found.filter("a != b")
        if not threshold <= 1 < below:
            return found
        x, y = members.alias("x"), members.alias("y")
        return found.unionByName(x.join(y, "name").filter("x.id < y.id").select(
            F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.lit(1.0).alias("sim"),
            F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b")))


def _own(name: str) -> Column:
    return F.expr(f"substring({name}, 2)")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim")


def _pair_rows(threshold: float, limit: int | None = None, below: float = 9.0, unfold: bool = False) -> Callable:
    def kernel(sims: np.ndarray, row) -> pd.DataFrame:
        i, j = np.nonzero((sims >= threshold) & (sims < below))
        ids_l, ids_r = np.asarray(row.ids_l, dtype=object), np.asarray(row.ids_r, dtype=object)
        if unfold:  # an id is no pair with itself
            other = ids_l[i] != ids_r[j]
            i, j = i[other], j[other]
        found = sims[i, j]
        if limit is not None and len(found) > limit:
            # Ties at the cut stay in: the final order breaks them by id.
            floor = np.partition(found, len(found) - limit)[len(found) - limit]
            keep = found >= floor
            i, j, found = i[keep], j[keep], found[keep]
        a, b = ids_l[i], ids_r[j]
        if unfold:
            return pd.DataFrame({
                "a": a, "b": b, "sim": found,
                "n_a": np.asarray(row.weights_l, dtype=np.int64)[i], "n_b": np.asarray(row.weights_r, dtype=np.int64)[j]})
        swap = a > b
        return pd.DataFrame(
            {"a": np.where(swap, b, a), "b": np.where(swap, a, b), "sim": found}
        )

    return kernel


_PAIR = "a string, b string, sim double"
_WEIGHED = f"{_PAIR}, n_a bigint, n_b bigint"


def cosine_pairs(
    df: DataFrame, threshold: float = dims.COSINE_THRESHOLD,
    id_col: str = "id", vec: str = "embedding", n_cells: int | None = None, copies: bool = False,
) -> DataFrame:
    """(a, b, sim) for every two distinct vectors with cosine >= threshold, a < b; with `copies` for
    every two rows of different ids, those of equal vectors included."""
    if copies:
        return _Prepared(df, id_col, vec, threshold, n_cells, unfold=True).unfolded(threshold)
    return _Prepared(df, id_col, vec, threshold, n_cells).run(_pair_rows(threshold), _PAIR)


def cosine_links(
    df: DataFrame, threshold: float = dims.COSINE_THRESHOLD,
    id_col: str = "id", vec: str = "embedding", n_cells: int | None = None,
) -> DataFrame:
    """Edges (a, b) with the same connected components as all similar pairs.

    Vectors within half the allowed angle of their pivot, its ball, are all similar to each
    other: they hang on one of them and are never compared among themselves. Whatever else
    touches a ball is linked to it once, not to its members.
    """
    prepared = _Prepared(df, id_col, vec, threshold, n_cells, skip_balls=True)

    def contacts(hit: np.ndarray, row) -> pd.DataFrame:
        i, j = np.nonzero(hit)
        if not len(i):
            return pd.DataFrame({"a": [], "b": []})
        left, left_names = pd.factorize(np.asarray(row.ids_l, dtype=object))
        right, right_names = pd.factorize(np.asarray(row.ids_r, dtype=object))
        once = pd.unique(left[i] * len(right_names) + right[j])  # a ball is met by many of its members
        a, b = left_names[once // len(right_names)], right_names[once % len(right_names)]
        swap = a > b
        return pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b)})

    met = prepared.run(contacts, "a string, b string", _reaching(threshold)).distinct()
    if prepared.n == 0:
        return met
    ball = prepared.placed.filter(F.col("role") == _BALL).select("cell", "id")
    heads = ball.groupBy("cell").agg(F.min("id").alias("head"))  # one row per cell
    stars = (
        ball.join(F.broadcast(heads), "cell").filter(F.col("id") != F.col("head"))
        .select(F.col("head").alias("a"), F.col("id").alias("b"))
    )
    marks = heads.select(ball_mark(F.col("cell")).alias("mark"), "head")
    for side in ("a", "b"):
        met = (
            met.join(F.broadcast(marks.withColumnRenamed("mark", side)), side, "left")
            .withColumn(side, F.coalesce("head", side)).drop("head")
        )
    return met.unionByName(stars).unionByName(prepared.copies)


def top_pairs(
    df: DataFrame, low: float, high: float, n: int = dims.BAND_ROWS,
    id_col: str = "id", vec: str = "embedding", n_cells: int | None = None, copies: bool = False,
) -> DataFrame:
    """The `n` most similar pairs with low <= cosine < high, of distinct vectors or, with `copies`, of
    rows; every tile pair reports at most its own best `n` (and ties)."""
    if copies:
        found = _Prepared(df, id_col, vec, low, n_cells, unfold=True).unfolded(low, n, high)
    else:
        found = _Prepared(df, id_col, vec, low, n_cells).run(_pair_rows(low, n, high), _PAIR)
    return found.orderBy(F.desc("sim"), "a", "b").limit(n)


def pair_counts(
    df: DataFrame, thresholds: list[float], id_col: str = "id", vec: str = "embedding",
    n_cells: int | None = None,
) -> DataFrame:
    """(threshold, pairs): how many pairs reach each threshold. Pairs are counted where they
    meet and never emitted; copies of a vector count with their multiplicity."""
    prepared = _Prepared(df, id_col, vec, min(thresholds), n_cells)
    grid = np.asarray(thresholds, dtype=np.float64)

    def kernel(sims: np.ndarray, row) -> pd.DataFrame:
        weight = np.outer(np.asarray(row.weights_l), np.asarray(row.weights_r))
        return pd.DataFrame({
            "threshold": grid,
            "pairs": [int(weight[sims >= t].sum()) for t in grid],
        })

    met = prepared.run(kernel, "threshold double, pairs bigint")
    among_copies = prepared.reps.filter("weight > 1").select(
        F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"),
        F.expr("weight * (weight - 1) div 2").alias("pairs"),
    )
    zero = prepared.reps.sparkSession.createDataFrame(
        [(float(t), 0) for t in thresholds], "threshold double, pairs bigint"
    )
    return met.unionByName(among_copies).unionByName(zero).groupBy("threshold").agg(
        F.sum("pairs").alias("pairs")
    )

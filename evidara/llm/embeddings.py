"""Embedding near-dedup by a subspace pigeonhole join.

Vectors are normalised and rotated onto the corpus's principal axes, and the rotated coordinates are
cut into blocks of BLOCK dimensions. Cosine >= c means a squared distance of at most 2 - 2c; if every
block took more than its share of that budget (in proportion to the block's variance) the whole would
be over it, so a linked pair is within its share in at least one block. Each block is range-joined on
its own: a vector's home is the cell of the nearest of the block's pivots, and it visits every later
cell that its ball of the block's radius can reach over the plane between the two pivots, so a pair
within the radius meets in exactly one cell. Pivots come from the sample that fits the rotation, as
many as keep the mean number of visits there at VISITS: many where vectors lie in clusters, one where
nothing can be told apart.

The range join carries block coordinates only, two bytes a dimension, and tells which vectors of a cell
have a partner within the block's budget. Whole vectors travel to a cell only for those; there each
surviving pair is verified by its exact cosine in double precision, and a cosine too close to the
threshold for the product's last bits is summed again in one fixed order.

Coordinates are rounded to integers before any distance or cell is computed from them, so every task
that meets a pair decides alike; radii are widened by what the rounding can take. A pair is counted
only in its first block within budget, so the union needs no pair table: a task returns a count for
each vector and a spanning forest of its links. Equal vectors are one row with their copies' number
from the start. Cells of more than TILE vectors are cut into tiles that meet pairwise, so a hot cell is
spread over many tasks; no cell is capped.

Defined cases: null labels, null, empty or zero vectors and vectors with null or non-finite
components link with nothing and are kept; vectors of different length never link; a repeated vec_id
is two vectors of one id, and they count as linked with each other if their vectors allow it; a null
vec_id keeps its row with null component_id; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .tables import cut, reread, sampled

BLOCK = 16
#: About so many vectors at most fit the rotation and the pivots. It needs no more: any rotation and any pivots find every pair, better ones with less work.
MAX_FIT = 8_000
#: Pivots of a block at most, and cells that a vector visits in the mean.
PIVOTS, VISITS = 256, 3.0
#: Vectors of a cell that meet in one task, and rows of their distances at once.
TILE, ROWS = 4_000, 512
#: Units of a vector's component, of a rotation's entry, and of a rotated coordinate.
UNIT, TURN, COORDINATE = 1 << 24, 1 << 20, 1 << 11
#: Cosines this near to the threshold are summed again.
CLOSE = 1e-9


def _valid():
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size("embedding") > 0) & whole & F.exists("embedding", lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, keepdims=True)
    x = x / np.where(top > 0, top, 1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _squares(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of rows of integers below 2 ** 11: sums of integers below 2 ** 24, exact in single precision."""
    p, q = p.astype(np.float32), q.astype(np.float32)
    return (p * p).sum(1)[:, None] + (q * q).sum(1)[None] - 2 * (p @ q.T)


class Subspaces:
    """By vector length: the rotation, the blocks, and each block's radius and pivots in rounded coordinates."""

    def __init__(self, sample: list[np.ndarray], cosine: float) -> None:
        self.total = 2 * (1 - cosine)
        self.known = {}
        for d in {len(v) for v in sample}:
            x = _unit(np.array([v for v in sample if len(v) == d]))
            variance, axes = np.linalg.eigh(x.T @ x / len(x))
            self._add(d, np.rint(axes[:, ::-1] * TURN), np.maximum(variance[::-1], 1e-9), x)

    def _add(self, d: int, turn: np.ndarray, variance: np.ndarray, x: np.ndarray) -> None:
        cuts = [(i, min(i + BLOCK, d)) for i in range(0, d, BLOCK)]
        share = np.array([variance[i:j].sum() for i, j in cuts])
        # each rounded difference of two coordinates is off by one at most
        reach = np.sqrt(self.total * share / share.sum()) * COORDINATE + np.sqrt([j - i for i, j in cuts]) + 1
        self.known[d] = (turn, cuts, reach, [np.zeros((1, j - i)) for i, j in cuts])
        y = self.coordinates(x)
        for k, (i, j) in enumerate(cuts):
            self.known[d][3][k] = self._pivots(d, k, np.unique(y[:, i:j], axis=0))

    def _pivots(self, d: int, k: int, y: np.ndarray) -> np.ndarray:
        n = min(PIVOTS, len(y) // 4)
        while n > 1:
            p = y[np.random.default_rng(3).choice(len(y), n, replace=False)]
            for _ in range(2):  # two rounds of k-means
                near = _squares(y, p).argmin(1)
                p = np.array([np.rint(y[near == c].mean(0)) if (near == c).any() else p[c] for c in range(n)])
            p = np.unique(p, axis=0)
            self.known[d][3][k] = p
            if self.visits(d, k, y)[1].sum() <= VISITS * len(y):
                return p
            n //= 2
        return np.zeros((1, y.shape[1]))

    def of(self, d: int):
        if d not in self.known:
            self._add(d, np.eye(d) * TURN, np.ones(d), np.zeros((0, d)))
        return self.known[d]

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        """Rotated and rounded coordinates; the product is of integers whose sums stay below 2 ** 53 (their squares' sums bound them), so the same in any order."""
        return np.rint((np.rint(_unit(x) * UNIT) @ self.known[x.shape[1]][0]) / (UNIT * TURN / COORDINATE))

    def visits(self, d: int, k: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows of a block's coordinates: their home cells, and whether they visit each cell (rows x pivots)."""
        _, _, reach, pivots = self.known[d]
        p = pivots[k]
        far = _squares(y, p).astype(float)
        home = far.argmin(1)
        apart = np.sqrt(_squares(p, p).astype(float))[home]
        within = far - far[np.arange(len(y)), home][:, None] <= 2 * reach[k] * apart + 1
        return home, within & (np.arange(len(p))[None] > home[:, None])


def _place(spaces: Subspaces):
    """For each vector and block: its coordinates in its home cell, and in the cells that it visits."""
    kinds = [("label", pa.int64()), ("d", pa.int32()), ("block", pa.int32()), ("cell", pa.int32()), ("visitor", pa.int32()), ("cid", pa.int64()), ("at", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = [np.asarray(v, np.float64) for v in b.column("embedding").to_pylist()]
            ids, label = b.column("cid").to_numpy(), b.column("label").to_numpy()
            for d in sorted({len(v) for v in vectors}):
                rows = np.array([i for i, v in enumerate(vectors) if len(v) == d])
                _, cuts, _, _ = spaces.of(d)
                y = spaces.coordinates(np.array([vectors[i] for i in rows])).astype(np.int16)
                for k, (i, j) in enumerate(cuts):
                    home, also = spaces.visits(d, k, y[:, i:j])
                    who, cell = np.nonzero(also)
                    of = np.concatenate([np.arange(len(rows)), who])
                    raw = [v.tobytes() for v in np.ascontiguousarray(y[:, i:j])]
                    n = len(of)
                    out = [label[rows[of]], np.full(n, d), np.full(n, k), np.concatenate([home, cell]), np.arange(n) >= len(rows), ids[rows[of]], [raw[o] for o in of]]
                    yield pa.RecordBatch.from_arrays([pa.array(o).cast(t) if not isinstance(o, list) else pa.array(o, t) for o, (_, t) in zip(out, kinds, strict=True)], [name for name, _ in kinds])

    return run


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    todo, out = np.ones(len(links), bool), []
    for root in range(len(links)):
        if todo[root]:
            todo[root] = False
            stack = [root]
            while stack:
                i = stack.pop()
                for j in np.flatnonzero(links[i] & todo).tolist():
                    todo[j] = False
                    out.append((i, j))
                    stack.append(j)
    return out


def _meetings(tile: pa.Table) -> tuple[np.ndarray, int, bool]:
    """The order that puts the tile's homes of this side first, their number, and whether they also meet each other."""
    home = tile["side"].to_numpy() == 0
    return np.argsort(~home, kind="stable"), int(home.sum()), tile["ti"][0].as_py() == tile["tj"][0].as_py()


def _range(spaces: Subspaces):
    """Of one tile of a cell: the vectors that have a partner within the block's budget."""

    def run(tile: pa.Table) -> pa.Table:
        d, k = tile["d"][0].as_py(), tile["block"][0].as_py()
        order, m, inner = _meetings(tile)
        y = np.array([np.frombuffer(v, np.int16) for v in tile["at"].to_pylist()], np.float32)[order]
        limit = np.float32(spaces.of(d)[2][k] ** 2)
        found = np.zeros(len(y), bool)
        first = 0 if inner else m
        for lo in range(0, m, ROWS):
            near = _squares(y[lo : min(lo + ROWS, m)], y[first:]) <= limit
            if inner:
                near &= np.arange(len(y))[None] > np.arange(lo, lo + len(near))[:, None]
            found[lo : lo + len(near)] |= near.any(1)
            found[first:] |= near.any(0)
        some = order[found]
        return tile.take(pa.array(some)).select(["label", "d", "block", "cell", "ti", "tj", "side", "cid"])

    return run


def _verify(spaces: Subspaces, cosine: float):
    """Of one tile's vectors that have partners: links counted in their first block, and a spanning forest."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(tile: pa.Table) -> pa.Table:
        d, block = tile["d"][0].as_py(), tile["block"][0].as_py()
        order, m, inner = _meetings(tile)
        x = np.array(tile["embedding"].to_pylist(), np.float64)[order]
        cid, n = tile["cid"].to_numpy()[order], tile["n"].to_numpy()[order]
        _, cuts, reach, _ = spaces.of(d)
        y, unit = spaces.coordinates(x), _unit(x)
        count, edges = np.zeros(len(x), np.int64), []
        for lo in range(0, m, ROWS):
            hi = min(lo + ROWS, m)
            near = _squares(y[lo:hi, slice(*cuts[block])], y[:, slice(*cuts[block])]) <= np.float32(reach[block] ** 2)
            near &= np.arange(len(x))[None] > np.arange(lo, hi)[:, None] if inner else np.arange(len(x))[None] >= m
            rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
            near = near[np.ix_(rows, cols)]
            rows += lo
            product = unit[rows] @ unit[cols].T
            close = np.argwhere(near & (np.abs(product - cosine) < CLOSE))
            if len(close):
                product[tuple(close.T)] = (unit[rows[close[:, 0]]] * unit[cols[close[:, 1]]]).sum(1)
            near &= product >= cosine
            first = near.copy()
            for k in range(block):
                first &= _squares(y[rows, slice(*cuts[k])], y[cols, slice(*cuts[k])]) > np.float32(reach[k] ** 2)
            count[rows] += first @ n[cols]
            count[cols] += first.T @ n[rows]
            some = np.unique(np.concatenate([rows, cols]))
            links = np.zeros((len(some), len(some)), bool)
            links[np.ix_(np.searchsorted(some, rows), np.searchsorted(some, cols))] = near
            edges += [(cid[some[i]], cid[some[j]]) for i, j in _forest(links | links.T)]
        counted = np.flatnonzero(count)
        a, b = [e[0] for e in edges], [e[1] for e in edges]
        return pa.Table.from_arrays(
            [pa.array([*a, *cid[counted].tolist()], pa.int64()), pa.array([*b, *[None] * len(counted)], pa.int64()), pa.array([*[None] * len(edges), *count[counted].tolist()], pa.int64())], schema=schema
        )

    return run


def groups(vectors: DataFrame, cosine: float) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors(vec_id, embedding, label)."""
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding").withColumn("valid", _valid())
    keyed = rows.withColumns({"k1": F.xxhash64("embedding"), "k2": F.xxhash64(F.lit(1), "embedding")})
    # copies of a vector with one label are one row; the sums start in the map tasks
    classes = keyed.where("valid").groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("smallest"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    # numbers that no two classes share; they are fixed by writing them down
    classes = reread(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    sample = classes.where(sampled("k1", MAX_FIT / max(1, classes.count()))).select("label", "k1", "k2", "embedding").collect()
    spaces = Subspaces([np.array(r["embedding"], np.float64) for r in sorted(sample, key=lambda r: (r["k1"], r["k2"], r["label"]))], cosine)
    placed = cut(classes.select("label", "cid", "embedding").mapInArrow(_place(spaces), "label long, d int, block int, cell int, visitor int, cid long, at binary"))
    cell = ["label", "d", "block", "cell"]
    hot = placed.groupBy(*cell).agg(F.count("*").alias("size")).where(F.col("size") > TILE).select(*cell, F.ceil(F.col("size") / TILE).cast("int").alias("m"))
    placed = placed.join(hot, cell, "left").withColumn("m", F.coalesce("m", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("m")).cast("int"))
    tile = lambda i, j, side: F.struct(i.cast("int").alias("ti"), j.cast("int").alias("tj"), F.lit(side).alias("side"))
    every = F.sequence(F.lit(0), F.col("m") - 1)
    mine = F.concat(F.transform(every, lambda j: tile(F.col("chunk"), j, 0)), F.transform(F.filter(every, lambda i: i < F.col("chunk")), lambda i: tile(i, F.col("chunk"), 1)))
    tiles = F.when(F.col("visitor") == 0, mine).otherwise(F.transform(every, lambda i: tile(i, F.col("chunk"), 1)))
    found = placed.select(*cell, "cid", "at", F.inline(tiles)).groupBy(*cell, "ti", "tj").applyInArrow(_range(spaces), "label long, d int, block int, cell int, ti int, tj int, side int, cid long")
    whole = classes.select("cid", "n", "embedding").hint("merge")
    met = cut(cut(found).join(whole, "cid").groupBy(*cell, "ti", "tj").applyInArrow(_verify(spaces, cosine), "a long, b long, n long"))
    links = met.where("n is not null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("links"))
    joined = components(met.where("b is not null").select("a", "b")).withColumnRenamed("node", "cid")
    out = classes.select("label", "k1", "k2", "cid", "n", "smallest").join(links, "cid", "left").join(joined, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    lowest = out.groupBy("component").agg(F.min("smallest").alias("component_id"))
    of_class = out.join(lowest, "component").select("label", "k1", "k2", F.lit(True).alias("valid"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    result = keyed.select("vec_id", "label", "k1", "k2", "valid").join(of_class, ["label", "k1", "k2", "valid"], "left")
    return result.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"))

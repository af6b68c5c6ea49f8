"""Retrievers (vector, keyword, hybrid) with top-k per query, and their comparison.

Both retrievers are exact and skip what cannot be among the k best. Vectors lie in cells around pivots, and the
triangle inequality bounds the similarity to anything in a cell; postings lie in shards of rules, and
a term's highest weight in a shard bounds what the shard's rules can score. A query first looks where its bound is
highest, and then only where the bound reaches its k-th best score.

The index of the rules is carried to the queries where it is small, which is measured. Else queries that are few and
small, which is measured too, are carried to the rules, of whose words only those asked for are kept; and many queries
are joined with the cells or shards that they visit, as tables.

Defined cases: a null query_id or rule_id matches nothing; queries that share an id have one ranking, and rules that share
one are each in it; null and zero vectors, vectors with null or non-finite components and vectors of another
length score nothing, nor do null or empty texts; no queries or rules give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut

#: Bytes of rules (vectors, texts) up to which their index is carried to the queries.
SMALL = 32 << 20
#: Queries, and bytes of them, up to which they are carried to rules that are more.
FEW, ASKED = 1_000, 1 << 20
#: Pivots of the vectors' cells, and rules from whose sample they are taken; more or fewer only change the work.
PIVOTS, SAMPLE = 64, 2_000
#: Rules and queries of one task where cells are joined; bytes of text of one shard, and queries that meet it in one task.
TILE, SHARD, MET = 8_192, 4 << 20, 20_000
#: Shards of one task, on average; a task gets its shards in one batch.
SHARDS = 2
#: Scores and weights that are held at once, and texts whose words are.
HELD, TEXTS = 2_000_000, 1_000

HIT = "query_id long, rule_id long, score double"


class Retriever(Protocol):
    """query_id, rule_id, score, rank for queries against rules; every retriever has this shape."""

    def __call__(self, queries: DataFrame, rules: DataFrame, k: int) -> DataFrame: ...


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """The k best rules of each query, by score and then the smaller id. The limit is pushed below the shuffle (window group limit)."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("rule_id"))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Best:
    """The k best rules so far of each of some queries."""

    def __init__(self, ids: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.score, self.rule = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)

    def least(self) -> np.ndarray:
        """The score that a further rule must reach."""
        return self.score[:, -1]

    def add(self, rows: np.ndarray, score: np.ndarray, rule: np.ndarray) -> None:
        """Scores (rows x rules) of some of the queries; -inf is no hit."""
        # only what reaches the k-th best so far and the k-th best of the new ones is put in order
        floor = self.least()[rows]
        if score.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(score, -self.k, axis=1)[:, -self.k])
        row, at = np.nonzero((score >= floor[:, None]) & (score > -np.inf))
        held = np.repeat(np.arange(len(rows)), self.k)
        of, value, name = np.concatenate([held, row]), np.concatenate([self.score[rows].ravel(), score[row, at]]), np.concatenate([self.rule[rows].ravel(), rule[at]])
        order = np.lexsort((name, -value, of))
        order = order[np.searchsorted(of[order], np.arange(len(rows)))[:, None] + np.arange(self.k)]
        self.score[rows], self.rule[rows] = value[order], name[order]

    def table(self) -> pa.RecordBatch:
        ok = self.score > -np.inf
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, ok.sum(1))), pa.array(self.rule[ok]), pa.array(self.score[ok])], ["query_id", "rule_id", "score"])


def _bytes(df: DataFrame, size: Column) -> int:
    return int(df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"])


def _few(queries: DataFrame, size: Column) -> bool:
    found = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return found["n"] <= FEW and found["bytes"] <= ASKED


# vectors

UNIT = "id long, dim int, x binary"


def _units(rows: DataFrame, ident: str) -> DataFrame:
    """id, dim, x: vectors that can score, of length one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, v in zip(b.column(ident).to_pylist(), b.column("embedding"), strict=True):
                x = None if i is None or not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype(float)
                if x is not None and len(x) and np.isfinite(x).all() and x.any():
                    out.append((i, len(x), (x / np.sqrt((x * x).sum())).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["id", "dim", "x"])

    return rows.select(F.col(ident).cast("long"), "embedding").mapInArrow(run, UNIT)


def _matrix(x: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.to_pylist()), float).reshape(-1, dim)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


class Cells:
    """Pivots of each length of vectors, and of each cell the number and the least and largest angle of its rules."""

    def __init__(self, sample: list[tuple[int, bytes]]) -> None:
        self.pivots: dict[int, np.ndarray] = {}
        for dim in {d for d, _ in sample}:
            x = np.stack([np.frombuffer(v, float) for d, v in sample if d == dim])
            chosen = [0]
            far = _angles(x, x[:1])[:, 0]
            while len(chosen) < min(PIVOTS, len(x)) and far.max() > 1e-6:  # the one farthest from all so far
                chosen.append(int(far.argmax()))
                far = np.minimum(far, _angles(x, x[chosen[-1:]])[:, 0])
            self.pivots[dim] = x[chosen]
        self.known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def placed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and angle of vectors of one length; without pivots there is one cell of any angle."""
        if x.shape[1] not in self.pivots:
            return np.zeros(len(x), np.int64), np.zeros(len(x))
        angle = _angles(x, self.pivots[x.shape[1]])
        cell = angle.argmin(1)
        return cell, angle[np.arange(len(x)), cell]

    def learn(self, rows: list[tuple[int, int, int, float, float]]) -> None:
        """(dim, cell, rules, least angle, largest angle) of every cell that has rules."""
        for dim in {r[0] for r in rows}:
            own = sorted(r[1:] for r in rows if r[0] == dim)
            self.known[dim] = tuple(np.array([o[k] for o in own]) for k in range(4))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, their numbers of rules, and for each vector and cell the highest similarity that one of its rules can have."""
        dim = q.shape[1]
        if dim not in self.known:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((len(q), 0))
        cell, n, low, high = self.known[dim]
        if dim not in self.pivots:
            return cell, n, np.ones((len(q), 1))
        angle = _angles(q, self.pivots[dim][cell])
        return cell, n, np.cos(np.maximum(0, np.maximum(angle - high, low - angle)))

    @staticmethod
    def first(n: np.ndarray, bound: np.ndarray, k: int) -> np.ndarray:
        """For each vector the cells of the highest bounds that have more than k rules together."""
        order = np.argsort(-bound, axis=1, kind="stable")
        before = np.cumsum(n[order], axis=1) - n[order]
        out = np.zeros(bound.shape, bool)
        np.put_along_axis(out, order, before <= k, 1)
        return out


def _similar(ids: np.ndarray, q: np.ndarray, rule: np.ndarray, x: np.ndarray, best: Best, rows: np.ndarray, digits: int) -> None:
    step = max(1, HELD // max(1, len(rule)))
    for lo in range(0, len(rows), step):
        some = rows[lo : lo + step]
        best.add(some, np.where(rule[None] == ids[some][:, None], -np.inf, np.round(q[some] @ x.T, digits)), rule)


class Carried:
    """All rules (id, dim, x) by length and cell, for tasks that hold queries; counts the products that it takes."""

    def __init__(self, rules: pa.Table) -> None:
        dims, self.products, self.rules = rules["dim"].to_numpy(), 0, {}
        step = max(1, len(rules) // SAMPLE)
        self.cells = Cells(list(zip(dims[::step].tolist(), rules["x"].take(pa.array(np.arange(0, len(rules), step))).to_pylist(), strict=True)))
        for dim in np.unique(dims).tolist():
            own = rules.filter(pa.array(dims == dim))
            ids, x = own["id"].to_numpy(), _matrix(own["x"], dim)
            cell, angle = self.cells.placed(x)
            for c in np.unique(cell).tolist():
                self.rules[dim, c] = (ids[cell == c], x[cell == c])
            self.cells.learn([(dim, c, int((cell == c).sum()), float(angle[cell == c].min()), float(angle[cell == c].max())) for c in np.unique(cell).tolist()])

    def top(self, ids: np.ndarray, q: np.ndarray, k: int, digits: int) -> Best:
        """The k best rules of each of the vectors q of one length."""
        best, dim, slack = Best(ids, k), q.shape[1], 10.0**-digits
        cell, n, bound = self.cells.bounds(q)
        first = self.cells.first(n, bound, k) if len(cell) else bound > 0
        for rest in (False, True):
            for c in np.argsort(-n, kind="stable"):
                rows = np.flatnonzero(~first[:, c] & (bound[:, c] + slack >= best.least()) if rest else first[:, c])
                if len(rows):
                    rule, x = self.rules[dim, int(cell[c])]
                    self.products += len(rows) * len(rule)
                    _similar(ids, q, rule, x, best, rows, digits)
        return best


def vector_top_k(queries: DataFrame, rules: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """Cosine similarity of queries(query_id, embedding) and rules(rule_id, embedding), rounded, a query never meeting a rule of its own id."""
    asked, units = _units(queries, "query_id"), _units(rules, "rule_id")
    size = 8 * F.size("embedding") + 16
    if _bytes(rules, size) > SMALL:
        return _met_by_all(asked, units, k, digits) if _few(queries, size) else _joined_cells(cut(asked), cut(units), k, digits)
    carried = units.sparkSession.sparkContext.broadcast(Carried(units.toArrow()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = b.filter(pa.array(dims == dim))
                yield carried.value.top(own.column("id").to_numpy(), _matrix(own.column("x"), int(dim)), k, digits).table()

    return ranked(asked.mapInArrow(run, HIT), k)


def _met_by_all(asked: DataFrame, units: DataFrame, k: int, digits: int) -> DataFrame:
    """Few queries, carried to the rules; each task of rules gives its k best for each of them."""
    carried = units.sparkSession.sparkContext.broadcast(asked.toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, found = carried.value["dim"].to_numpy(), {}
        for dim in np.unique(dims).tolist():
            own = carried.value.filter(pa.array(dims == dim))
            found[dim] = Best(own["id"].to_numpy(), k), _matrix(own["x"], dim)
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in set(np.unique(dims).tolist()) & set(found):
                own, (best, q) = b.filter(pa.array(dims == dim)), found[dim]
                _similar(best.ids, q, own.column("id").to_numpy(), _matrix(own.column("x"), dim), best, np.arange(len(q)), digits)
        for best, _ in found.values():
            yield best.table()

    return ranked(units.mapInArrow(run, HIT), k)


def _joined_cells(asked: DataFrame, units: DataFrame, k: int, digits: int) -> DataFrame:
    """Queries joined with the cells that they visit: first the likeliest, then those that their k-th best score leaves."""
    # as many rows as the parameter says, those whose ids hash lowest
    cells = Cells([(r["dim"], bytes(r["x"])) for r in units.orderBy(F.xxhash64("id"), "id", "x").limit(SAMPLE).collect()])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            cell, angle = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                cell[at], angle[at] = cells.placed(_matrix(b.column("x").take(pa.array(at)), int(dim)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(angle)], ["id", "dim", "x", "cell", "angle"])

    placed = cut(units.mapInArrow(place, UNIT + ", cell int, angle double"))
    # a row a cell
    cells.learn([tuple(r) for r in placed.groupBy("dim", "cell").agg(F.count("*"), F.min("angle"), F.max("angle")).collect()])
    slack = 10.0**-digits
    sizes = {(dim, int(c)): int(n) for dim, (cell, n, _, _) in cells.known.items() for c, n in zip(cell, n, strict=True)}

    def visits(again: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                dims = b.column("dim").to_numpy()
                for dim in np.unique(dims):
                    own = b.filter(pa.array(dims == dim))
                    cell, n, bound = cells.bounds(_matrix(own.column("x"), int(dim)))
                    if not len(cell):
                        continue
                    go = cells.first(n, bound, k)
                    if again:
                        go = ~go & (bound + slack >= own.column("least").to_numpy()[:, None])
                    row, at = np.nonzero(go)
                    tiles = np.array([-(-sizes[int(dim), int(c)] // TILE) for c in cell], np.int32)
                    for lo in range(0, len(row), 4096):
                        some = own.take(pa.array(row[lo : lo + 4096]))
                        yield pa.RecordBatch.from_arrays([some.column("id"), some.column("dim"), some.column("x"), pa.array(cell[at[lo : lo + 4096]].astype(np.int32)), pa.array(tiles[at[lo : lo + 4096]])], ["id", "dim", "x", "cell", "tiles"])

        return run

    def meet(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        best = Best(left["id"].to_numpy(), k)
        if len(left) and len(right):
            _similar(best.ids, _matrix(left["x"], dim), right["id"].to_numpy(), _matrix(right["x"], dim), best, np.arange(len(left)), digits)
        return pa.Table.from_batches([best.table()])

    def hits(rows: DataFrame, again: bool) -> DataFrame:
        there = cut(rows.mapInArrow(visits(again), UNIT + ", cell int, tiles int"))
        # the rules of a cell are parted by tiles, and so are very many queries of one cell
        of_cell = there.groupBy("dim", "cell").agg(F.max("tiles").alias("tiles"), F.ceil(F.count("*") / TILE).cast("int").alias("shares"))
        left = there.drop("tiles").join(of_cell, ["dim", "cell"]).withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int")).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        right = placed.join(of_cell, ["dim", "cell"]).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        key = ["dim", "cell", "tile", "share"]
        return left.select(*key, "id", "x").groupBy(*key).cogroup(right.select(*key, "id", "x").groupBy(*key)).applyInArrow(meet, HIT)

    # queries of one id are told apart by their vectors
    found = cut(hits(asked, False))
    of_query = ranked(found, k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("least")).select(F.col("query_id").alias("id"), "least")
    more = asked.join(of_query, "id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    return ranked(found.union(hits(more, True)), k)


# words


def terms(text: Column) -> Column:
    """Lower-case runs of white-space-free characters."""
    return F.array_remove(F.split(F.lower(text), "[ \n\t\r]+"), "")


SHARDED = "shard int, rules binary, named binary, sizes binary, whole long, terms array<string>, begin binary, doc binary, tf binary"


class Postings:
    """One shard's postings by term: the rules (places in `rules`) that hold it and its weight there, idf left out."""

    def __init__(self, row: dict, mean: float, k1: float, b: float) -> None:
        """row: the columns of SHARDED, `terms` as an Arrow array."""
        part = lambda c, t: np.frombuffer(row[c], t)
        self.rules, self.named, self.begin, self.doc = part("rules", np.int64), part("named", bool), part("begin", np.int64), part("doc", np.int32)
        self.vocabulary, tf, size = row["terms"], part("tf", np.int32), part("sizes", np.int32)
        self.weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[self.doc] / mean))
        self.highest = np.maximum.reduceat(self.weight, self.begin[:-1]) if len(self.vocabulary) else self.weight

    @staticmethod
    def columns(rule: pa.Array, words: pa.Array) -> dict:
        """The columns of SHARDED but the shard, of rules and their words."""
        flat, doc = pc.list_flatten(words), pc.list_parent_indices(words).to_numpy().astype(np.int64)
        coded = flat.dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        term = place[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
        key, tf = np.unique(term * max(1, len(rule)) + doc, return_counts=True)
        term, doc = key // max(1, len(rule)), key % max(1, len(rule))
        return {
            "rules": rule.fill_null(0).to_numpy().tobytes(), "named": rule.is_valid().to_numpy(zero_copy_only=False).tobytes(), "sizes": pc.fill_null(pc.list_value_length(words), 0).to_numpy().astype(np.int32).tobytes(),
            "whole": len(words) - words.null_count, "terms": coded.dictionary.take(order), "begin": np.searchsorted(term, np.arange(len(order) + 1)).tobytes(), "doc": doc.astype(np.int32).tobytes(), "tf": tf.astype(np.int32).tobytes(),
        }

    def places(self, words: pa.Array) -> np.ndarray:
        """Each word's place in the vocabulary, -1 where the shard doesn't have it."""
        return pc.index_in(words, self.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def score(self, best: Best, rows: np.ndarray, query: np.ndarray, place: np.ndarray, idf: np.ndarray, digits: int) -> None:
        """Adds the scores of the queries `rows`; (query, place, idf) are their words that the shard has, in order of query and term."""
        pairs = np.bincount(query, np.diff(self.begin)[place], int(rows[-1]) + 1)[rows]
        for some in np.split(rows, np.flatnonzero(np.diff(np.cumsum(np.maximum(pairs, len(self.rules))) // HELD)) + 1):
            a, z = np.searchsorted(query, some[0]), np.searchsorted(query, some[-1], "right")
            own = np.searchsorted(some, query[a:z])
            own_ok = (own < len(some)) & (some[np.minimum(own, len(some) - 1)] == query[a:z])
            own, p, w = own[own_ok], place[a:z][own_ok], idf[a:z][own_ok]
            size = self.begin[p + 1] - self.begin[p]
            at = np.repeat(self.begin[p] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            total = np.bincount(np.repeat(own, size) * len(self.rules) + self.doc[at], np.repeat(w, size) * self.weight[at], len(some) * len(self.rules)).reshape(len(some), -1)
            total = np.round(total, digits)
            best.add(some, np.where((total > 0) & self.named[None], total, -np.inf), self.rules)


def _top_words(shards: list[Postings], ids: np.ndarray, begin: np.ndarray, words: pa.Array, idf: np.ndarray, k: int, digits: int) -> Best:
    """The k best rules of each query; begin are the queries' first words among `words`, idf those words' weights."""
    best, slack = Best(ids, k), 10.0**-digits
    query = np.repeat(np.arange(len(ids)), np.diff(begin))
    places = [s.places(words) for s in shards]
    bound = np.zeros((len(ids), len(shards)))
    for j, (s, p) in enumerate(zip(shards, places, strict=True)):
        has = p >= 0
        bound[:, j] = np.bincount(query[has], idf[has] * s.highest[p[has]], len(ids))
    first = bound.argmax(1) if len(shards) else np.zeros(len(ids), np.int64)
    for rest in (False, True):
        for j, (s, p) in enumerate(zip(shards, places, strict=True)):
            rows = np.flatnonzero((bound[:, j] > 0) & ((first != j) & (bound[:, j] + slack >= best.least()) if rest else first == j))
            if len(rows):
                has = p >= 0
                s.score(best, rows, query[has], p[has], idf[has], digits)
    return best


def _rows(t: pa.Table | pa.RecordBatch) -> list[dict]:
    """Rows as dictionaries in which lists stay Arrow arrays."""
    plain = lambda v: v.values if isinstance(v, pa.ListScalar) else v.as_py()
    return [{c: plain(t[c][k]) for c in t.schema.names} for k in range(t.num_rows)]


def _sizes(rows: list[dict]) -> tuple[int, float]:
    """The number of rules and their mean number of words."""
    size, whole = sum(int(np.frombuffer(r["sizes"], np.int32).sum()) for r in rows), sum(r["whole"] for r in rows)
    return sum(len(r["rules"]) // 8 for r in rows), size / whole if size else 1.0


def _build(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    group = group.sort_by("rule_id").combine_chunks()
    rule, words = (group[c].chunk(0) if len(group) else pa.array([], group.schema.field(c).type) for c in ("rule_id", "words"))
    row = {"shard": key[0].as_py()} | Postings.columns(rule, words)
    terms = row["terms"]
    kinds = {"shard": pa.int32(), "whole": pa.int64()}
    arrays = {c: pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms) if c == "terms" else pa.array([v], kinds.get(c, pa.binary())) for c, v in row.items()}
    return pa.Table.from_pydict(arrays)


def _index(rules: DataFrame, size: int) -> DataFrame:
    """A row of SHARDED for each shard of the rules, whose texts have `size` bytes."""
    shards = max(1, -(-size // SHARD))
    shard = F.pmod(F.xxhash64("rule_id", "text"), F.lit(shards)).cast("int")
    words = rules.select(shard.alias("shard"), F.col("rule_id").cast("long"), terms(F.col("text")).alias("words"))
    # Spark's own number of partitions is fixed and its batches are counted in rows: a task's batch would grow with the rules
    return words.repartition(max(rules.sparkSession.sparkContext.defaultParallelism, -(-shards // SHARDS)), "shard").groupBy("shard").applyInArrow(_build, SHARDED)


def keyword_top_k(queries: DataFrame, rules: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, digits: int = 6) -> DataFrame:
    """BM25 of queries(query_id, text) against rules(rule_id, text), rounded; each query word counts once.

    The rules' texts are cut into words once, however many queries there are; rules without an identifier count in
    the words' frequencies.
    """
    size = _bytes(rules, F.octet_length("text"))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.array_sort(F.array_distinct(terms(F.col("text")))).alias("words")).where("query_id is not null and size(words) > 0")
    if size > SMALL and _few(queries, F.octet_length("text")):
        return _asked_words(asked, rules, k, k1, b, digits)
    index = _index(rules, size)
    if size > SMALL:
        return _joined_shards(asked, cut(index), k, k1, b, digits)
    carried = index.sparkSession.sparkContext.broadcast(index.toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _rows(carried.value)
        n, mean = _sizes(own)
        shards = [Postings(row, mean, k1, b) for row in own]
        for batch in batches:
            lists = batch.column("words")
            flat = pc.list_flatten(lists)
            df = np.zeros(len(flat))
            for s in shards:
                p = s.places(flat)
                df += np.where(p >= 0, np.diff(s.begin)[p] if len(s.vocabulary) else 0, 0)
            begin = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
            yield _top_words(shards, batch.column("query_id").to_numpy(), begin, flat, np.log(1 + (n - df + 0.5) / (df + 0.5)), k, digits).table()

    return ranked(asked.mapInArrow(run, HIT), k)


def _asked_words(asked: DataFrame, rules: DataFrame, k: int, k1: float, b: float, digits: int) -> DataFrame:
    """Few queries, carried to the rules: once to keep the words asked for of each rule, and once, when these are counted, to score."""
    queries = asked.toArrow().combine_chunks()
    lists = queries["words"].chunk(0) if len(queries) else pa.array([], queries.schema.field("words").type)
    ids, flat = queries["query_id"].to_numpy(), pc.list_flatten(lists)
    begin = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)
    vocabulary = pc.unique(flat)
    vocabulary = vocabulary.take(pc.array_sort_indices(vocabulary))
    session = rules.sparkSession.sparkContext
    carried = session.broadcast(vocabulary)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = max(1, len(carried.value))
        for batch in (b.slice(lo, TEXTS) for b in batches for lo in range(0, len(b), TEXTS)):
            words = batch.column("words")
            place = pc.index_in(pc.list_flatten(words), carried.value)
            doc = pc.list_parent_indices(words).filter(place.is_valid()).to_numpy().astype(np.int64)
            key, tf = np.unique(doc * kinds + place.drop_null().to_numpy(), return_counts=True)
            of = pa.array(np.searchsorted(key // kinds, np.arange(len(batch) + 1)).astype(np.int32))
            kept = [pa.ListArray.from_arrays(of, pa.array(v.astype(np.int32))) for v in (key % kinds, tf)]
            yield pa.RecordBatch.from_arrays([batch.column("rule_id"), pc.list_value_length(words), *kept], ["rule_id", "size", "terms", "tf"])

    # a row a rule; a text that is null has no size
    held = cut(rules.select(F.col("rule_id").cast("long"), terms(F.col("text")).alias("words")).mapInArrow(keep, "rule_id long, size int, terms array<int>, tf array<int>"))
    sums = held.agg(F.count("*").alias("n"), F.count("size").alias("whole"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    n, mean = sums["n"], sums["size"] / sums["whole"] if sums["size"] else 1.0
    df = np.zeros(len(vocabulary))
    for r in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row a word asked for
        df[r["term"]] = r["count"]
    weights = np.log(1 + (n - df + 0.5) / (df + 0.5))[pc.index_in(flat, vocabulary).to_numpy()]
    asking = session.broadcast((ids, begin, flat, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, begin, flat, weights = asking.value
        for batch in batches:
            lists = batch.column("terms")
            term, doc, tf = pc.list_flatten(lists).to_numpy(), pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(batch.column("tf")).to_numpy()
            order = np.argsort(term, kind="stable")
            own, start = np.unique(term[order], return_index=True)
            row = {"rules": batch.column("rule_id").to_numpy(), "named": np.ones(len(batch), bool), "sizes": batch.column("size").to_numpy(), "begin": np.append(start, len(term)), "doc": doc[order].astype(np.int32), "tf": tf[order]}
            shard = Postings({c: v.tobytes() for c, v in row.items()} | {"terms": carried.value.take(pa.array(own))}, mean, k1, b)
            yield _top_words([shard], ids, begin, flat, weights, k, digits).table()

    return ranked(held.where("rule_id is not null and size(terms) > 0").mapInArrow(run, HIT), k)


def _joined_shards(asked: DataFrame, index: DataFrame, k: int, k1: float, b: float, digits: int) -> DataFrame:
    """Queries joined with the shards that they visit: first the one of the highest bound, then those that their k-th best score leaves."""
    slack = 10.0**-digits

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (len(row["rules"]) // 8, row["whole"], int(np.frombuffer(row["sizes"], np.int32).sum()))], ["n", "whole", "size"])

    sums = index.mapInArrow(summed, "n long, whole long, size long").agg(F.sum("n").alias("n"), F.sum("whole").alias("whole"), F.sum("size").alias("size")).first()
    n, mean = sums["n"] or 0, sums["size"] / sums["whole"] if sums["size"] else 1.0

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                s = Postings(row, mean, k1, b)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s.vocabulary), row["shard"], np.int32)), s.vocabulary, pa.array(s.highest, pa.float64()), pa.array(np.diff(s.begin))], ["shard", "term", "highest", "df"])

    blocks = cut(index.mapInArrow(bounded, "shard int, term string, highest double, df long"))
    df = blocks.groupBy("term").agg(F.sum("df").cast("double").alias("df"))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # rows of one query id are told apart by their words
    asked = cut(asked.withColumn("q", F.struct("query_id", F.xxhash64("words").alias("h"))))
    weighed = asked.select("q", F.explode("words").alias("term")).distinct().join(df, "term").select("q", "term", idf.alias("idf"))
    whole = cut(weighed.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("term", "idf"))).alias("w")))
    bounds = cut(weighed.join(blocks.select("term", "shard", "highest"), "term").groupBy("q", "shard").agg(F.sum(F.col("idf") * F.col("highest")).alias("bound")))
    first = bounds.groupBy("q").agg(F.max_by("shard", F.struct("bound", -F.col("shard"))).alias("shard"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.Table.from_batches([Best(np.zeros(0, np.int64), k).table()])
        shard = Postings(_rows(right.combine_chunks())[0], mean, k1, b)
        lists = left["w"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        flat = pc.list_flatten(lists)
        begin = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        return pa.Table.from_batches([_top_words([shard], left["query_id"].to_numpy(), begin, flat.field("term"), flat.field("idf").to_numpy(), k, digits).table()])

    def hits(visits: DataFrame) -> DataFrame:
        shares = visits.groupBy("shard").agg(F.ceil(F.count("*") / MET).cast("int").alias("shares"))
        left = visits.join(shares, "shard").withColumn("share", F.pmod(F.xxhash64("q"), F.col("shares")).cast("int")).join(whole, "q").select("shard", "share", F.col("q.query_id").alias("query_id"), "w")
        right = index.join(shares, "shard").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
        return left.groupBy("shard", "share").cogroup(right.groupBy("shard", "share")).applyInArrow(meet, HIT)

    found = cut(hits(first))
    least = ranked(found, k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    rest = bounds.join(first.withColumnRenamed("shard", "shard_"), "q").where("shard <> shard_").withColumn("query_id", F.col("q.query_id")).join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") + slack >= F.col("least")))
    return ranked(found.union(hits(rest.select("q", "shard"))), k)


def hybrid(rankings: list[DataFrame], k: int, constant: int = 60, digits: int = 9) -> DataFrame:
    """Reciprocal-rank fusion of rankings(query_id, rule_id, rank)."""
    hits = reduce(DataFrame.union, [r.select("query_id", "rule_id", "rank") for r in rankings])
    return ranked(hits.groupBy("query_id", "rule_id").agg(F.round(F.sum(1 / (F.lit(constant) + F.col("rank"))), digits).alias("score")), k)


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both rankings side by side: query_id, rule_id, rank_a, rank_b, differs."""
    left = a.select("query_id", "rule_id", F.col("rank").alias("rank_a"))
    right = b.select("query_id", "rule_id", F.col("rank").alias("rank_b"))
    return left.join(right, ["query_id", "rule_id"], "full").withColumn("differs", ~F.col("rank_a").eqNullSafe(F.col("rank_b")))


def recall(expected: DataFrame, hits: DataFrame, case: str) -> DataFrame:
    """One row: cases, and the share of cases all of whose expected(case, rule_id) are among hits(case, rule_id)."""
    missed = expected.join(hits, [case, "rule_id"], "left_anti").select(case).distinct()
    cases = expected.select(case).distinct().join(missed.withColumn("missed", F.lit(1)), case, "left")
    return cases.agg(F.count("*").alias("cases"), F.round(F.avg(F.when(F.col("missed").isNull(), 1.0).otherwise(0.0)), 6).alias("recall"))

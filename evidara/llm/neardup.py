"""MinHash near-dedup with SetSketch registers.

A document's shingle set is sketched into REGISTERS truncated, exponentially spaced minima: register
j holds floor(1 - log_b h), clipped to 0..LIMIT, of the smallest of the set's exponential hashes h
for j. Sketches of a union merge by the larger register, and equal sets have equal registers. BANDS
bands of ROWS registers propose candidates; at a Jaccard similarity of 0.8 all bands miss with a
probability below 1e-5, at 0.9 below 1e-13. For a candidate pair the likelihood of how often the
registers of one are above, below or equal to the other's gives an estimate of its similarity; only
pairs clearly below the threshold are left out by it, the rest are verified on the full sets.

Exact copies of a set, by a hash of 128 bits, are one class from the start. Registers are written once
a class and decide first which pairs are worth verifying; full sets are made again only for one document
of each class that shares a bucket. Texts are not shuffled for that: a bit table of fixed size tells
each task which of its documents may be wanted, and a join on the few sets that come out settles it.
Of the classes that share a bucket, `own` counts
the shingles that no other such class has: what two classes have in common is at most the smaller
of their sizes without their own shingles, which bounds their similarity from above and rules out,
without loss, most pairs that only share a frequent passage. Classes of one bucket are not paired
with each other: the bucket's centre meets the members of other components, a few rounds long (first
the class that shares buckets most often, so that edited copies meet their original). What is then
left in a bucket with several components is compared pair by pair across them: in small buckets by a
join, in large ones in tiles of TILE classes that return links only, each pair in its first common
bucket. So a group of k copies costs k pairs a round, no table of its pairs is ever made, and still
no link between different components is lost: every pair of one bucket that is left out is joined
by a path of verified links or ruled out by the bound.

Defined cases: texts without words (null, empty) have an empty set and link with nothing; exact
duplicates of a row (same doc_id too) are one node; rows that share a doc_id but not their set are
nodes of their own; a null doc_id is linked with nothing and keeps its row; an empty table gives no
rows. `groups` ignores extra columns and answers each row. `kept` leaves one row of each group with
all its columns: of the smallest doc_id, of that the smallest class, of exact repeats the one whose
columns hash lowest; rows without words or doc_id all stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .tables import bit_table, cut, may_hold, pieces, reread
from .textarrays import NOT_SPACE, Hasher, lowered, mixed, shingles, text_slices, words

ROWS, BANDS = 6, 40
REGISTERS = ROWS * BANDS
BASE, LIMIT = 1.01, 4000
#: Rounds of centres before the rest is compared outright.
ROUNDS = 2
#: So many pairs at most count as few: the numbers of their classes (16 bytes a pair) are broadcast.
FEW = 200_000
#: Members of a bucket whose pairs are joined, and of a tile of larger ones.
SMALL, TILE = 16, 1_000
#: Standard errors of the estimate below the threshold at which a pair is left out.
SLACK = 7.0

#: Bits of the table of wanted documents.
WANTED_BITS = 25

SET = ["c1", "c2"]
SKETCHED = "doc_id long, t1 long, t2 long, n_shingles long, c1 long, c2 long, registers binary"


def registers(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """SetSketch registers (rows x REGISTERS, uint16) of non-empty sets of 64-bit hashes."""
    rate = np.random.default_rng(11).integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(begin) - 1, REGISTERS), np.uint16)
    for j in range(REGISTERS):
        least = np.minimum.reduceat(h * rate[j], begin[:-1])
        # -log(1 - u) of a uniform u is exponential; u is small in large sets
        x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64)
        out[:, j] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LIMIT)
    return out


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin (texts + 1 values)."""
    low = lowered(data)
    starts, ends, first = words(low, off, NOT_SPACE)
    h, begin = shingles(hasher.of(low, starts, ends), first, size)
    row = np.repeat(np.arange(len(off) - 1), np.diff(begin))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(off) - 1))])


def class_names(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The indices of the texts with a non-empty set, and a hash of two numbers that names each one's set."""
    n = np.diff(at)
    some = np.flatnonzero(n)
    if not len(some):
        return some, np.zeros(0, np.int64), np.zeros(0, np.int64)
    one, two = (mixed(np.add.reduceat(mixed(h * np.uint64(2 * k + 1) + np.uint64(77 + k)), at[:-1][some]) + n[some].astype(np.uint64)).view(np.int64) for k in (0, 1))
    return some, one, two


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in pieces(batches):
            ids = b.column("doc_id").cast(pa.int64())
            for lo, hi, data, off in text_slices(b.column("text")):
                h, at = shingle_sets(data, off, size, hasher)
                some, *names = class_names(h, at)
                c, sketches = np.zeros((2, hi - lo), np.int64), [None] * (hi - lo)
                c[:, some] = names
                if len(some):
                    for i, r in zip(some, registers(h, np.append(at[:-1][some], len(h))), strict=True):
                        sketches[i] = r.tobytes()
                n = np.diff(at)
                yield pa.RecordBatch.from_arrays(
                    [ids[lo:hi], b.column("t1")[lo:hi], b.column("t2")[lo:hi], pa.array(n, pa.int64()), *(pa.array(x, mask=n == 0) for x in c), pa.array(sketches, pa.binary())], ["doc_id", "t1", "t2", "n_shingles", *SET, "registers"]
                )

    return run


def _sets(size: int, wanted: bytes):
    """Sets of the documents that the bit table lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in pieces(batches):
            b = b.filter(pa.array(may_hold(wanted, b.column("bit").to_numpy(zero_copy_only=False))))
            ids = b.column("doc_id").cast(pa.int64()).to_numpy()
            for lo, hi, data, off in text_slices(b.column("text")):
                h, at = shingle_sets(data, off, size, hasher)
                some, one, two = class_names(h, at)
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][some]), pa.array(one), pa.array(two), pa.array([h[at[i] : at[i + 1]].tobytes() for i in some], pa.binary())], ["smallest", *SET, "shingles"])

    return run


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from two sketches' registers and set sizes.

    With u = na / union, v = nb / union exclusive to one set in shares u - J, v - J, a register of a
    is above b's with probability p(v's smaller reach): -log_b(1 - x (b - 1) / b) for x the share of
    the union that only a holds. The likelihood of (above, below, equal) is maximised on a grid.
    """
    up, down = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - up - down
    j = np.linspace(0.005, 1.0, 200)
    total = (na + nb)[:, None] / (1 + j)
    x, y = np.clip(1 - nb[:, None] / total, 0, 1), np.clip(1 - na[:, None] / total, 0, 1)
    p = lambda t: np.clip(-np.log(1 - t * (BASE - 1) / BASE) / np.log(BASE), 1e-9, 1)
    px, py = p(x), p(y)
    score = up[:, None] * np.log(px) + down[:, None] * np.log(py) + same[:, None] * np.log(np.clip(1 - px - py, 1e-9, 1))
    score[(nb[:, None] > total) | (na[:, None] > total)] -= 1e9
    return j[score.argmax(1)]


def _pairs(b: pa.RecordBatch, ok: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(ok)) for k in ("a", "b")], ["a", "b"])


def _likely(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            reg = lambda n: np.frombuffer(b"".join(b.column(n).to_pylist()), np.uint16).reshape(-1, REGISTERS)  # noqa: E731,B023
            size = lambda n: b.column(n).to_numpy().astype(float)  # noqa: E731,B023
            yield _pairs(b, estimate(reg("ra"), reg("rb"), size("na"), size("nb")) >= _least(percent) if b.num_rows else np.zeros(0, bool))

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sa, sb = ([np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(k)] for k in ("sa", "sb"))
            yield _pairs(b, np.array([_similar(x, y, percent) for x, y in zip(sa, sb, strict=True)], bool))

    return run


def _beside(pairs: DataFrame, table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """pairs(a, b) with the table's columns for a and for b, under their new names followed by a and b; nothing bounds the table, so it is never broadcast."""
    side = lambda k: table.select(F.col("class").alias(k), *[F.col(c).alias(new + k) for c, new in columns.items()]).hint("merge")
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *[new + k for new in columns.values() for k in "ab"])


def linked(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of pairs whose sets are similar enough; pairs hold each (a, b) once, sketches(class, size, registers) and sets(class, shingles) each class once.

    Registers meet first, and only pairs whose estimate allows it fetch their sets.
    """
    pairs = cut(pairs)
    few = lambda p, table: cut(table.join(F.broadcast(p.select(F.explode(F.array("a", "b")).alias("class")).distinct()), "class", "left_semi")) if p.count() <= FEW else table
    likely = cut(_beside(pairs, few(pairs, sketches), {"registers": "r", "size": "n"}).mapInArrow(_likely(percent), "a long, b long"))
    return _beside(likely, few(likely, sets), {"shingles": "s"}).mapInArrow(_verify(percent), "a long, b long")


def band_keys(r: np.ndarray) -> np.ndarray:
    """A key for each band of each sketch, of the band's number and its registers."""
    r = r.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(48), r.shape[:2])
    for k in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + r[:, :, k])
    return key


def band_values(classes: DataFrame) -> DataFrame:
    """(key, band, class): one row for each class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            key = band_keys(np.frombuffer(b"".join(b.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(key))), pa.array(np.repeat(b.column("class").to_numpy(), BANDS))], ["key", "band", "class"])

    return classes.select("class", "registers").mapInArrow(run, "key long, band int, class long")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _least(percent: int) -> float:
    """Estimates below this are left out."""
    return percent / 100 - SLACK * float(np.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS))


def _tile(percent: int):
    """Links between the components of one tile of a bucket; those that an earlier link of the tile implies are left out."""

    def run(tile: pa.Table) -> pa.Table:
        name, component, home = tile["class"].to_numpy(), tile["component"].to_numpy(), tile["side"].to_numpy() == 0
        n, rest = tile["size"].to_numpy().astype(float), (tile["size"].to_numpy() - tile["own"].to_numpy()).astype(float)
        reg = np.frombuffer(b"".join(tile["registers"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
        sets = [np.frombuffer(x, np.uint64) for x in tile["shingles"].to_pylist()]
        inner, band = tile["ti"][0].as_py() == tile["tj"][0].as_py(), tile["band"][0].as_py()
        a, b = np.flatnonzero(home), np.arange(len(name)) if inner else np.flatnonzero(~home)
        keys = band_keys(reg)
        common = np.minimum(rest[a][:, None], rest[b][None])
        meet = (component[a][:, None] != component[b][None]) & (100 * common >= percent * (n[a][:, None] + n[b][None] - common))
        if inner:
            meet &= a[:, None] < b[None]
        for k in range(band):  # met in that bucket
            meet &= keys[a, k][:, None] != keys[b, k][None]
        head: dict[int, int] = {}

        def top(c: int) -> int:
            while head.get(c, c) != c:
                c = head[c]
            return c

        found = []
        i, j = np.nonzero(meet)
        for lo in range(0, len(i), 4096):
            x, y = a[i[lo : lo + 4096]], b[j[lo : lo + 4096]]
            likely = estimate(reg[x], reg[y], n[x], n[y]) >= _least(percent)
            for p, q in zip(x[likely].tolist(), y[likely].tolist(), strict=True):
                s, t = top(int(component[p])), top(int(component[q]))
                if s != t and _similar(sets[p], sets[q], percent):
                    head[s] = t
                    found.append((name[p], name[q]))
        return pa.Table.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def tiled(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components within large buckets; large(key, band, class, component, size, own, n)."""
    large = large.withColumn("m", F.ceil(F.col("n") / TILE).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("m")).cast("int"))
    every = F.sequence(F.lit(0), F.col("m") - 1)
    tile = lambda i, j, side: F.struct(i.cast("int").alias("ti"), j.cast("int").alias("tj"), F.lit(side).alias("side"))
    own = F.transform(F.filter(every, lambda j: j >= F.col("chunk")), lambda j: tile(F.col("chunk"), j, 0))
    other = F.transform(F.filter(every, lambda i: i < F.col("chunk")), lambda i: tile(i, F.col("chunk"), 1))
    placed = large.select("key", "band", "class", "component", "size", "own", F.inline(F.concat(own, other)))
    return placed.join(sets.hint("merge"), "class").groupBy("key", "ti", "tj").applyInArrow(_tile(percent), "a long, b long")


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        raw = b.column("shingles").to_pylist()
        h = np.frombuffer(b"".join(raw), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.repeat(b.column("class").to_numpy(), [len(r) // 8 for r in raw]))], ["shingle", "class"])


def _possible(percent: int, size: str, own: str, other_size: str, other_own: str):
    """Whether two classes can reach the similarity: they share at most the smaller rest after their own shingles."""
    common = F.least(F.col(size) - F.col(own), F.col(other_size) - F.col(other_own))
    return 100 * common >= percent * (F.col(size) + F.col(other_size) - common)


def class_links(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, component) over the classes that are linked with another one; classes(class, c1, c2, smallest, size, registers)."""
    keyed = band_values(classes)
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = cut(keyed.join(shared.hint("merge"), "key"))
    mates = cut(buckets.groupBy("class").agg(F.sum("n").alias("mates")))
    # full sets are made again only for one document of each class that shares a bucket
    wanted = cut(classes.join(mates.select("class").hint("merge"), "class").select("class", *SET, "smallest", "size", "registers"))
    texts = docs.where("doc_id is not null").select("doc_id", "text", _bit("doc_id").alias("bit"))
    made = texts.mapInArrow(_sets(size, bit_table(wanted.select(_bit("smallest").alias("bit")), WANTED_BITS)), "smallest long, c1 long, c2 long, shingles binary")
    sets = cut(wanted.select("class", *SET, "smallest").join(made.hint("merge"), [*SET, "smallest"]).select("class", "shingles").dropDuplicates(["class"]))
    sketches = wanted.select("class", "size", "registers")
    alone = sets.mapInArrow(_exploded, "shingle long, class long").groupBy("shingle").agg(F.count("*").alias("n"), F.min("class").alias("class")).where("n = 1")
    own = alone.groupBy("class").agg(F.count("*").alias("own"))
    sizes = wanted.select("class", "size").join(own.hint("merge"), "class", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    able = sizes.where(100 * (F.col("size") - F.col("own")) >= percent * F.col("size"))
    labelled = cut(buckets.select("key", "band", "class").join(able.join(mates, "class").hint("merge"), "class").withColumn("component", F.col("class")))
    edges = classes.sparkSession.createDataFrame([], "a long, b long")
    for number in range(ROUNDS + 1):
        if number:
            found = components(edges).select(F.col("node").alias("class"), F.col("component").alias("now"))
            labelled = labelled.join(found, "class", "left").withColumn("component", F.coalesce("now", "class")).drop("now")
        # a bucket of one component has nothing left to say
        several = labelled.groupBy("key").agg((F.min("component") != F.max("component")).alias("open")).where("open").select("key")
        labelled = cut(labelled.join(several, "key"))
        if labelled.isEmpty():
            break
        last = number == ROUNDS
        if last:
            sized = labelled.join(labelled.groupBy("key").agg(F.count("*").alias("n")), "key")
            few = sized.where(F.col("n") <= SMALL)
            other = few
        else:
            order = F.struct(-F.col("mates") if not number else F.lit(0), F.xxhash64("class", F.lit(number)), "class")
            few = labelled
            other = labelled.groupBy("key").agg(F.min_by(F.struct("class", "size", "own", "component"), order).alias("c")).select("key", "c.*")
        other = other.select(F.col("key").alias("key_"), F.col("class").alias("other"), F.col("size").alias("size_"), F.col("own").alias("own_"), F.col("component").alias("component_"))
        meet = few.join(other, (F.col("key") == F.col("key_")) & (F.col("component") != F.col("component_")) & _possible(percent, "size", "own", "size_", "own_"))
        pairs = meet.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct()
        more = linked(pairs, sketches, sets, percent)
        if last:
            more = more.union(tiled(sized.where(F.col("n") > SMALL), sets.join(sketches.drop("size"), "class"), percent))
        edges = cut(edges.union(more))
    return components(edges)


def _bit(doc_id: str):
    return F.pmod(F.xxhash64(doc_id), F.lit(1 << WANTED_BITS))


def _grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, t1, t2 (a hash of the text), n_shingles, c1, c2, component_id, head (whether the class is its component's first) for every row of docs(doc_id, text)."""
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    rows = reread(hashed.mapInArrow(_sketch(size), SKETCHED), "sketches")
    nodes = rows.where("doc_id is not null and c1 is not null")
    classes = nodes.groupBy(*SET).agg(F.min("doc_id").alias("smallest"), F.first("n_shingles").alias("size"), F.first("registers").alias("registers"))
    # numbers that no two classes share; they are fixed by writing them down
    classes = reread(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    joined = class_links(docs, classes, size, percent).withColumnRenamed("node", "class")
    grouped = cut(classes.select("class", *SET, "smallest").join(joined, "class", "left").withColumn("component", F.coalesce("component", "class")))
    first = grouped.groupBy("component").agg(F.min(F.struct("smallest", *SET)).alias("first"))
    of_class = grouped.join(first.hint("merge"), "component").select(*SET, F.col("first.smallest").alias("component_id"), (F.struct("smallest", *SET) == F.col("first")).alias("head"))
    # the rows of a class of very many copies are split by the skew join, as nothing above it needs them together
    return rows.drop("registers").join(of_class.hint("merge"), SET, "left")


def groups(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs(doc_id, text): word shingles of `size`, similarity of at least `percent` in a hundred."""
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return _grouped(docs, size, percent).select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))


def kept(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """One row of each group of docs, all columns, and the rows that can't link."""
    key = ["id", "t1", "t2"]
    # the whole row is one column beside the join's, so no extra column can clash
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    free = F.col("id").isNull() | ~F.coalesce(F.col("row.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    first = _grouped(docs.select("doc_id", "text"), size, percent).where(F.col("head") & (F.col("doc_id") == F.col("component_id"))).select(F.col("doc_id").alias("id"), "t1", "t2", *SET)
    # texts of one set that differ, as in white space or case: one of them
    first = first.groupBy("id", *SET).agg(F.min(F.struct("t1", "t2")).alias("t")).select("id", "t.t1", "t.t2")
    found = rows.where(~free).join(first.hint("merge"), key, "left_semi")
    once = found.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("row")))).where("nth = 1").select("row.*")
    return rows.where(free).select("row.*").unionByName(once)

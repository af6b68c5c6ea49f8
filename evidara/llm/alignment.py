"""Alignment of two tokenizers' tokens by a sweep over the places where they end.

Both vocabularies cut the same bytes. A token's end is an event; events of A and B travel as runs: the ids of
a stretch of text and where it begins, from which the ends follow by the tokens' known lengths. The runs
of both sides are united, repartitioned so that a document's are together, sorted by document and
offset, and read by a machine that keeps the open group's place and one stretch of events: where an A
and a B token end together a group ends, and each stretch between neighbouring ends, of whichever side,
is what one A and one B token have in common, a link.

How many documents hold an id pair linked, and which pair is the most frequent of its A id, is known
only once all have been swept. A first sweep gives each block of documents its distinct pairs with
their numbers of documents; these are shuffled by A id, summed, and sent back to the blocks that hold them,
where a second sweep over the same shuffled runs (one exchange, read twice) adds them up by
document. So links are never rows: what is shuffled is the runs once and the distinct pairs of
blocks twice. A block is a run of whole documents of about BLOCK bytes of text.

Defined cases: a text that is null, empty, not UTF-8, or of which either side's tokens give other bytes has
no tokens and zeros; repeated rows, and rows that share a doc_id, are documents of their own; a null doc_id
stays null; extra columns are ignored; an empty table gives no rows. Which block a row is in depends
on the order of the input's rows, which must be the same if a task is run again, as it is for a file scan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import TwoVocabularies, id_code, kept

#: Bytes of text of one block, and events swept at once.
BLOCK, SWEPT = 8 << 20, 1 << 18

RUN = "block long, row int, doc_id long, start long, side int, ids binary"
#: Start of the row that says that a document has no tokens, before all of its runs.
NONE = -1
ROW = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def runs(docs: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """The events of docs(doc_id, text) as runs: A's (side 0) and B's (side 1) of one stretch have the same bytes; a document without tokens has one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = kept(("two", a_path, b_path), lambda: TwoVocabularies(a_path, b_path, pattern))
        pack = zstandard.ZstdCompressor(level=1).compress
        block, row, held = TaskContext.get().partitionId() << 32, 0, 0
        out: list[tuple] = []
        size = 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
                raw = text.as_py() or b""
                if held and held + len(raw) > BLOCK:
                    block, row, held = block + 1, 0, 0
                row, held = row + 1, held + len(raw)
                ok = bool(raw)
                for start, ids in both.encode(raw) if raw else ():
                    if ids is None:
                        ok = False
                        break
                    for side in (0, 1):
                        out.append((block, row, doc_id, start, side, pack(ids[side])))
                        size += len(out[-1][-1]) + 64
                    if size > 4 << 20:
                        yield _table(out)
                        out, size = [], 0
                if not ok:
                    out.append((block, row, doc_id, NONE, 0, None))
        yield _table(out)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RUN)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [c.split(" ")[0] for c in RUN.split(", ")])


class Sweep:
    """The machine's view of some stretches in order: all of A's and B's ends, counted from the first stretch's first byte."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], lengths: tuple[np.ndarray, np.ndarray]) -> None:
        self.a, self.b = np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)
        self.end_a, self.end_b = np.cumsum(lengths[0][self.a]), np.cumsum(lengths[1][self.b])
        ends = np.concatenate([self.end_a, self.end_b])
        ends.sort(kind="stable")  # two sorted runs: a merge
        again = ends[1:] == ends[:-1]
        self.common = ends[1:][again]
        self.ends = ends[np.concatenate([[True], ~again])] if len(ends) else ends
        #: for each stretch the places of its last A token, B token, group and link, plus one
        at = np.cumsum([len(x) for x in a])
        last = self.end_a[at - 1]
        self.stops = np.stack([at, np.cumsum([len(x) for x in b]), np.searchsorted(self.common, last, "right"), np.searchsorted(self.ends, last, "right")])

    def pairs(self, width: int) -> np.ndarray:
        """The link that ends at each end, as a * width + b."""
        return self.a[np.searchsorted(self.end_a, self.ends)] * width + self.b[np.searchsorted(self.end_b, self.ends)]

    def written(self, sizes: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Places in `spelled` of the groups' text, A's ids then B's group by group, and where each stretch's end."""
        last_a, last_b = np.searchsorted(self.end_a, self.common), np.searchsorted(self.end_b, self.common)
        before_b, upto_a = np.concatenate([[0], last_b + 1]), np.concatenate([last_a + 1, [len(self.a)]])
        code_a, code_b = self.a.copy(), self.b + 2 * sizes[0]
        code_a[last_a] += sizes[0]
        code_b[last_b] += sizes[1]
        out = np.empty(len(self.a) + len(self.b), np.int64)
        out[np.arange(len(self.a)) + before_b[np.searchsorted(self.common, self.end_a)]] = code_a
        out[np.arange(len(self.b)) + upto_a[np.searchsorted(self.common, self.end_b)]] = code_b
        return out, self.stops[0] + self.stops[1]


def spelled(sizes: tuple[int, int]) -> np.ndarray:
    """An id of A with ',' or, last of its group, '|' behind it, an id of B with ',' or ';'."""
    return np.array([b"%d%s" % (i, mark) for size, marks in zip(sizes, ((b",", b"|"), (b",", b";")), strict=True) for mark in marks for i in range(size)], object)


def stretches(rows: Iterator[tuple[int, int, int | None, int, int, bytes | None]], sizes: tuple[int, int]) -> Iterator[list[tuple[tuple[int, int], int | None, np.ndarray, np.ndarray]]]:
    """Sorted run rows -> lists of ((block, row), doc_id, A's ids, B's ids) of about SWEPT events; a list never spans two blocks, and documents without tokens have empty ids."""
    unpack = zstandard.ZstdDecompressor().decompress
    codes = [np.uint16 if id_code(n) == "H" else np.uint32 for n in sizes]
    out: list[tuple] = []
    events, skipped, left = 0, None, None
    for block, row, doc_id, start, side, ids in rows:
        key = (block, row)
        if out and (events >= SWEPT or out[-1][0][0] != block):
            yield out
            out, events = [], 0
        if start == NONE:
            skipped = key
            out.append((key, doc_id, np.zeros(0, codes[0]), np.zeros(0, codes[1])))
        elif key != skipped:
            found = np.frombuffer(unpack(ids), codes[side])
            events += len(found)
            if side == 0:
                left = found
            else:
                out.append((key, doc_id, left, found))
    if out:
        yield out


def _sorted_rows(t: pa.Table | pa.RecordBatch) -> Iterator[tuple]:
    names = [c.split(" ")[0] for c in RUN.split(", ")]
    return zip(*(t.column(n).to_pylist() for n in names), strict=True)


def _distinct(found: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with the sums of their counts."""
    value, count = np.concatenate(found), np.concatenate(counts)
    order = np.argsort(value, kind="stable")
    value, count = value[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    return value[first], np.add.reduceat(count, first) if len(first) else count


def _pair_counts(a_path: str, b_path: str, pattern: str):
    """First sweep: (block, a, b, docs), how many documents of the block hold the pair linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = kept(("two", a_path, b_path), lambda: TwoVocabularies(a_path, b_path, pattern))
        lengths, width = both.lengths(), both.sizes[1]
        block, found, counts, size = None, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        long_doc, own = None, np.zeros(0, np.int64)  # a document that goes on in the next list

        def emitted() -> Iterator[pa.RecordBatch]:
            value, count = _distinct([*found, own], [*counts, np.ones(len(own), np.int64)])
            for lo in range(0, len(value), 1 << 16):
                v = value[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), block)), pa.array((v // width).astype(np.int32)), pa.array((v % width).astype(np.int32)), pa.array(count[lo : lo + (1 << 16)])], ["block", "a", "b", "docs"])

        for some in stretches((r for b in batches for r in _sorted_rows(b)), both.sizes):
            if some[0][0][0] != block:
                if block is not None:
                    yield from emitted()
                block, found, counts, size, long_doc, own = some[0][0][0], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, None, np.zeros(0, np.int64)
            some = [s for s in some if len(s[2])]
            if not some:
                continue
            sweep = Sweep([s[2] for s in some], [s[3] for s in some], lengths)
            pair = sweep.pairs(width)
            doc = np.cumsum([0] + [s[0] != t[0] for s, t in zip(some[1:], some, strict=False)])
            of_link = np.repeat(doc, np.diff(sweep.stops[3], prepend=0))
            if some[0][0] != long_doc:
                found.append(own)
                counts.append(np.ones(len(own), np.int64))
                own = np.zeros(0, np.int64)
            # the list's first document may go on from the one before, its last into the next
            first, last = of_link == 0, of_link == doc[-1]
            if doc[-1] == 0:
                own = np.unique(np.concatenate([own, pair]))
            else:
                found.append(np.unique(np.concatenate([own, pair[first]])))
                middle = ~(first | last)
                keyed = np.unique(of_link[middle] * (both.sizes[0] * width) + pair[middle]) % (both.sizes[0] * width)
                found.append(keyed)
                counts += [np.ones(len(f), np.int64) for f in found[-2:]]
                own = np.unique(pair[last])
            long_doc = some[-1][0]
            if sum(map(len, found)) > 2 * size + (1 << 22):
                value, count = _distinct(found, counts)
                found, counts, size = [value], [count], len(value)
        if block is not None:
            yield from emitted()

    return run


def _aligned(a_path: str, b_path: str, pattern: str):
    """Second sweep: the row of each document of a block, with the counts of the block's pairs."""

    def run(events: pa.Table, known: pa.Table) -> pa.Table:
        both = kept(("two", a_path, b_path), lambda: TwoVocabularies(a_path, b_path, pattern))
        lengths, sizes = both.lengths(), both.sizes
        names = kept(("spelled", a_path, b_path), lambda: spelled(sizes))
        pair = known["a"].to_numpy().astype(np.int64) * sizes[1] + known["b"].to_numpy()
        order = np.argsort(pair)
        pair, count, best = pair[order], known["count"].to_numpy()[order], known["best"].to_numpy(zero_copy_only=False)[order].astype(np.int64)
        events = events.sort_by([("row", "ascending"), ("start", "ascending"), ("side", "ascending")])
        rows: list[list] = []
        key, digest = None, None

        def close() -> None:
            if key is not None and digest is not None:
                rows[-1][-1] = digest.hexdigest()

        batches = (r for b in events.to_batches(max_chunksize=256) for r in _sorted_rows(b))
        for some in stretches(batches, sizes):
            full = [s for s in some if len(s[2])]
            if full:
                sweep = Sweep([s[2] for s in full], [s[3] for s in full], lengths)
                at = np.searchsorted(pair, sweep.pairs(sizes[1]))
                stops = np.concatenate([np.zeros((4, 1), np.int64), sweep.stops], axis=1)
                total = [np.concatenate([[0], np.cumsum(v[at])])[stops[3]] for v in (best, count)]
                numbers = np.diff(np.concatenate([stops, total]), axis=1).T.tolist()
                codes, upto = sweep.written(sizes)
                written, upto = names[codes].tolist(), [0, *upto.tolist()]
            k = 0
            for own, doc_id, a, _ in some:
                if own != key:
                    close()
                    key, digest = own, None
                    rows.append([doc_id, 0, 0, 0, 0, 0, 0, ""])
                if len(a):
                    rows[-1][1:7] = [x + y for x, y in zip(rows[-1][1:7], numbers[k], strict=True)]
                    text = b"".join(written[upto[k] : upto[k + 1]])[:-1]
                    if digest is None:
                        digest = hashlib.sha256(text)
                    else:
                        digest.update(b";")
                        digest.update(text)
                    k += 1
        close()
        kinds = [pa.int64()] * 7 + [pa.string()]
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [c.split(" ")[0] for c in ROW.split(", ")])

    return run


def align(docs: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of docs(doc_id, text).

    a_path is a byte-level BPE file with its pretoken pattern, b_path a sentencepiece BPE model.
    """
    files = (a_path, b_path, pattern)
    made = runs(docs, *files)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    events = made.repartition(parts, "block").sortWithinPartitions("block", "row", "start", "side")
    blocks = events.mapInArrow(_pair_counts(*files), "block long, a int, b int, docs long")
    # by A id: its pairs' counts and the highest of them need one exchange
    of_pair, of_a = Window.partitionBy("a", "b"), Window.partitionBy("a")
    counted = blocks.repartition("a").withColumn("count", F.sum("docs").over(of_pair)).withColumn("best", F.col("count") == F.max("count").over(of_a))
    return events.groupBy("block").cogroup(counted.select("block", "a", "b", "count", "best").groupBy("block")).applyInArrow(_aligned(*files), ROW)


def links(docs: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """doc_id, group (from 0 in each document), a, b for every link of docs(doc_id, text), in the order of the text."""
    files = (a_path, b_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = kept(("two", a_path, b_path), lambda: TwoVocabularies(a_path, b_path, pattern))
        lengths, width = both.lengths(), both.sizes[1]
        key, groups = None, 0  # of the open document
        for some in stretches((r for b in batches for r in _sorted_rows(b)), both.sizes):
            some = [s for s in some if len(s[2])]
            if not some:
                continue
            sweep = Sweep([s[2] for s in some], [s[3] for s in some], lengths)
            pair, group = sweep.pairs(width), np.searchsorted(sweep.common, sweep.ends)
            lo, before = 0, 0
            for (own, doc_id, _, _), upto, stop in zip(some, sweep.stops[2], sweep.stops[3], strict=True):
                groups = groups if own == key else 0
                key, n = own, stop - lo
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * n, pa.int64()), pa.array(group[lo:stop] - before + groups), pa.array((pair[lo:stop] // width).astype(np.int32)), pa.array((pair[lo:stop] % width).astype(np.int32))], ["doc_id", "group", "a", "b"])
                groups, before, lo = groups + upto - before, upto, stop

    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    events = runs(docs, *files).repartition(parts, "block").sortWithinPartitions("block", "row", "start", "side")
    return events.mapInArrow(run, "doc_id long, group long, a int, b int")

"""Benchmark decontamination by SimHash fingerprints of item-sized windows.

An item is fingerprinted at every offset in windows a little shorter than itself, a document at
every few words in windows of the same size, so that a passage is met at equal alignment however it
lies in the document. One contiguous edit in the middle lies in all of those, so an item is also
fingerprinted in windows small enough for the longer of the two runs that such an edit leaves: every
edit of one block that keeps an item-sized window of the document at SIMILARITY leaves an aligned
window without a change. Scattered edits are found as far as a window stays within RADIUS.
Fingerprints are 64-bit SimHashes of the words; the index cuts them into four
16-bit parts and holds each part with all its one-bit changes, so every pair within a Hamming
distance of RADIUS = 7 agrees in a part and is found. A candidate names an item and where it begins; the
similarity there is exact: the weighted Jaccard similarity of five-word shingles, the item's shingles
weighing log(1 + items / items that hold them) over the whole benchmark, all others log(1 + items).
Words may have been put in or left out, so of all windows whose ends lie up to a quarter of the item's
length (and a word) from where they would be expected, the most similar one counts.

The benchmark is split by hash into parts of about PART bytes. The driver makes their indexes one after the other, and
each is a broadcast of its own, which tasks open one at a time: what a task and the driver hold is bounded,
no item is left out, and what a part finds does not depend on how the benchmark was split. All parts
are matched in one pass over the documents, whose words are hashed once; documents are never shuffled.

Defined cases: null or empty texts match nothing; an item of fewer than five words is one shingle;
items with equal texts all match; items that share an id are items of their own, each reported under it;
repeated rows are each reported; a null doc_id or item_id is reported as null; extra columns are
ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut, pieces
from .textarrays import NOT_SPACE, Hasher, lowered, shingles, text_slices, words

SHINGLE, SIMILARITY = 5, 0.8
PART = 1 << 20
BLOCK = 1 << 13
RADIUS = 7
BITS, PARTS = 64, 4


def stride(window: int) -> int:
    return max(1, min(8, window // 4))


def fitting(run: int) -> int:
    """The largest window of the ladder that has an aligned place in every run of so many words."""
    size, best = 1, 1
    while size + stride(size) - 1 <= run:
        best, size = size, max(size + 1, size * 7 // 5)
    return best


def window_of(length: int) -> int:
    """The window for an item of so many words that avoids its ends' changed words."""
    return fitting(length - ((length - SHINGLE + 1) // 9 if length >= SHINGLE else 0))


def clean_run(weight: np.ndarray, length: int) -> int:
    """The least that one contiguous edit can leave as its longer unchanged run, in words, of an item of so many words and these weights of its shingles in order.

    A passage at SIMILARITY holds at least that share of the item's weight, so the edit's shingles weigh at most the rest.
    """
    if length < SHINGLE:
        return length
    total = np.concatenate([[0.0], np.cumsum(weight)])
    begin = np.arange(length)
    before = total[np.maximum(0, begin - SHINGLE + 1)]
    last = np.searchsorted(total, before + (1 - SIMILARITY) * total[-1] + 1e-9, "right") - 1
    end = np.where(last == len(weight), length, last)
    return int(np.where(end > begin, np.maximum(begin, length - end), length).min())


class BitSums:
    """Sums of the words' hash bits over runs of 2^k words, from which those of any window are put together."""

    def __init__(self, h: np.ndarray, longest: int) -> None:
        kind = np.uint8 if longest < 256 else np.uint32
        self.runs = [np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(kind, copy=False)]
        while 2 << len(self.runs) - 1 <= longest:
            last, half = self.runs[-1], 1 << len(self.runs) - 1
            self.runs.append(last[:-half] + last[half:] if len(last) > half else last[:0])

    def fingerprints(self, at: np.ndarray, window: int) -> np.ndarray:
        """SimHashes of the windows that begin at `at`: the majority of each bit."""
        total, place = None, at
        for k in range(window.bit_length() - 1, -1, -1):
            if window >> k & 1:
                part = self.runs[k][place]
                total = part if total is None else np.add(total, part, out=total)
                place = place + (1 << k)
        return np.packbits(total > window // 2, axis=1).view(np.uint64).ravel()


class Index:
    """Fingerprints of one part of the benchmark, by window size."""

    def __init__(self, items: list[tuple[int, str]], total: int, known: np.ndarray, holders: np.ndarray) -> None:
        """Of the benchmark's `total` items some; known are these items' shingles in order, holders how many items of the whole benchmark hold each."""
        hasher = Hasher()
        self.ids = [i for i, _ in items]
        self.shingles: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # distinct ones in order, how often each, and its weight
        self.lengths: list[int] = []
        self.unseen = math.log(1 + total)
        entries: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        weigh = lambda s: np.log(1 + total / holders[np.searchsorted(known, s)])
        for k, (_, text) in enumerate(items):
            h, made = words_and_shingles(text, hasher)
            distinct, n = np.unique(made, return_counts=True)
            self.shingles.append((distinct, n, weigh(distinct)))
            self.lengths.append(len(h))
            if len(h):
                large = window_of(len(h))
                for w in {large, min(large, fitting(clean_run(weigh(made), len(h))))}:
                    at = np.arange(len(h) - w + 1)
                    entries[w].append((BitSums(h, w).fingerprints(at, w), np.stack([np.full(len(at), k), at], 1).astype(np.int32)))
        self.tables = {}
        flips = np.concatenate([[0], 1 << np.arange(16)]).astype(np.uint64)
        for w, rows in entries.items():
            prints, who = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
            parts = []
            for p in range(PARTS):
                value = (((prints >> np.uint64(16 * p)) & np.uint64(0xFFFF))[:, None] ^ flips).astype(np.uint16)
                order = np.argsort(value.ravel(), kind="stable")
                begin = np.searchsorted(value.ravel()[order], np.arange(65537))
                parts.append((begin, (order // len(flips)).astype(np.int32)))
            self.tables[w] = (prints, who, parts)

    def candidates(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rows of (row, item, word of the row where the item would begin), each once and in order.

        The windows are taken by the block of BLOCK words they begin in, so memory follows the index and not the text.
        """
        longest = max(self.tables, default=0)
        found = [np.zeros((0, 3), np.int64)]
        for lo in range(0, len(h) if longest else 0, BLOCK):
            total = BitSums(h[lo : lo + BLOCK + longest], longest)
            rows = np.arange(np.searchsorted(first, lo, "right") - 1, min(len(first) - 1, np.searchsorted(first, lo + BLOCK)))
            found += [self._near(total, lo, w, rows, first) for w in self.tables]
        return np.unique(np.concatenate(found), axis=0)

    def _near(self, total: BitSums, lo: int, w: int, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Candidates of one window size among the rows' windows that begin in the block at word lo."""
        prints, who, parts = self.tables[w]
        step = stride(w)
        begin, n = first[rows], first[rows + 1] - first[rows]
        skipped = np.maximum(0, -((begin - lo) // step))  # windows of the row before the block
        end = np.minimum(np.where(n >= w, (n - w) // step + 1, 0), -((begin - lo - BLOCK) // step))
        count = np.maximum(0, end - skipped)
        row = np.repeat(rows, count)
        place = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - skipped, count)) * step
        f = total.fingerprints(first[row] + place - lo, w)
        found = [np.zeros((0, 3), np.int64)]
        for p, (lists, entry) in enumerate(parts):
            v = ((f >> np.uint64(16 * p)) & np.uint64(0xFFFF)).astype(np.int64)
            size = lists[v + 1] - lists[v]
            some = np.flatnonzero(size)
            size = size[some]
            at = np.repeat(lists[v[some]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            window, e = np.repeat(some, size), entry[at]
            near = np.bitwise_count(f[window] ^ prints[e]) <= RADIUS
            window, e = window[near], e[near]
            found.append(np.stack([row[window], who[e, 0], place[window] - who[e, 1]], 1))
        return np.concatenate(found)

    def similarity(self, item: int, window: np.ndarray) -> float:
        """Weighted Jaccard similarity of the item's shingles and a window's, repeats counted."""
        mine, n, weight = self.shingles[item]
        theirs, m = np.unique(window, return_counts=True)
        if not len(theirs):
            return 0.0
        at = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
        same = np.where(theirs[at] == mine, m[at], 0)
        both = float((weight * np.minimum(n, same)).sum())
        other = self.unseen * float(m.sum() - same.sum()) + float((weight * np.maximum(same - n, 0)).sum())
        return both / (float((weight * n).sum()) + other)

    def best_window(self, item: int, made: np.ndarray, place: int, words: int) -> tuple[float, int, int]:
        """Similarity, first word and word after the last of the window most like the item, its ends near place and place + length, in a row of so many words with the shingles `made`.

        Sums along the row bound each window's similarity (repeats aside, they are it), so few are worked out.
        """
        length = self.lengths[item]
        mine, n, weight = self.shingles[item]
        room = length // 4 + 1
        if length < SHINGLE or words < SHINGLE:
            lo, hi = max(0, place), min(words, place + length)
            # one shingle: the whole sequence
            return (self.similarity(item, made[lo:hi]) if words < SHINGLE else 0.0, lo, hi)
        first, last = max(0, place - room), min(len(made), place + length - SHINGLE + 1 + room)
        begin = np.arange(first, max(first, min(place + room, len(made) - 1)) + 1)
        end = np.arange(max(1, min(place + length - SHINGLE + 1 - room, last)), max(1, last) + 1)
        near = made[first:last]
        at = np.minimum(np.searchsorted(mine, near), len(mine) - 1)
        inside = mine[at] == near
        total = lambda v: np.concatenate([np.zeros(first + 1), np.cumsum(v)])
        both, other = total(np.where(inside, weight[at], 0.0)), total(np.where(inside, 0.0, self.unseen))
        span = end[None] > begin[:, None]
        alike = np.where(span, both[end][None] - both[begin][:, None], 0.0)
        bound = alike / (np.maximum(float((weight * n).sum()), alike) + np.where(span, other[end][None] - other[begin][:, None], 0.0))
        best = (0.0, 0, 0)
        for k in np.argsort(-bound, axis=None, kind="stable"):
            i, j = divmod(int(k), len(end))
            if bound[i, j] < SIMILARITY or bound[i, j] <= best[0]:
                break
            exact = self.similarity(item, made[begin[i] : end[j]])
            if exact > best[0]:
                best = (exact, int(begin[i]), int(end[j]) + SHINGLE - 1)
        return best

    def matches(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """(row, item's place, similarity, first word, word after the last) of the best window for each row and item that reaches SIMILARITY; h are the rows' words, and first where each row's begin."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        of_row, made = -1, np.zeros(0, np.uint64)
        for row, item, place in self.candidates(h, first).tolist():
            mine = h[first[row] : first[row + 1]]
            if row != of_row:
                of_row, (made, _) = row, shingles(mine, np.array([0, len(mine)]), SHINGLE)
            if self.lengths[item] < SHINGLE:  # one shingle, the whole sequence
                lo, hi = max(0, place), min(len(mine), place + self.lengths[item])
                found = (self.similarity(item, shingles(mine[lo:hi], np.array([0, hi - lo]), SHINGLE)[0]), lo, hi)
            else:
                found = self.best_window(item, made, place, len(mine))
            if found[0] >= SIMILARITY and found[0] > best.get((row, item), (0.0,))[0]:
                best[row, item] = found
        return [(r, i, *v) for (r, i), v in best.items()]


def words_and_shingles(text: str, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's words and of its shingles, in order."""
    data = lowered(np.frombuffer(text.encode(), np.uint8))
    starts, ends, first = words(data, np.array([0, len(data)]), NOT_SPACE)
    h = hasher.of(data, starts, ends)
    return h, shingles(h, first, SHINGLE)[0]


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of each item, with its part."""
    hasher = Hasher()
    for b in batches:
        for part, text in zip(b.column("part").to_pylist(), b.column("text").to_pylist(), strict=True):
            made = np.unique(words_and_shingles(text, hasher)[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(made), part), pa.int32()), pa.array(made.view(np.int64))], ["part", "shingle"])


def benchmark_parts(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark's indexes, one part after the other; a part is what its hash says and about PART bytes."""
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("bytes"), F.count("*").alias("items")).first()
    parts = max(1, -(-int(size["bytes"]) // PART))
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int"))
    held = items.select("part", "text").mapInArrow(_item_shingles, "part int, shingle long")
    holders = cut(held.groupBy("shingle").agg(F.count("*").alias("holders")))
    known = cut(held.distinct().join(holders, "shingle"))
    for k in range(parts):
        part = items.where(F.col("part") == k).collect()
        if part:
            # as many rows as the part has shingles
            weights = known.where(F.col("part") == k).select("shingle", "holders").toArrow()
            shingle = weights["shingle"].to_numpy().view(np.uint64)
            order = np.argsort(shingle)
            in_order = sorted(((r["item_id"], r["text"]) for r in part), key=lambda i: (i[0] is not None, i[0] or 0, i[1]))
            yield Index(in_order, size["items"], shingle[order], weights["holders"].to_numpy()[order])


class Parts:
    """The indexes of the whole benchmark as broadcasts."""

    def __init__(self, benchmark: DataFrame) -> None:
        sc = benchmark.sparkSession.sparkContext
        self.indexes = [sc.broadcast(i) for i in benchmark_parts(benchmark)]

    def __iter__(self) -> Iterator[Index]:
        for b in self.indexes:
            yield b.value
            if len(self.indexes) > 1:
                vars(b).pop("_value", None)  # it is read again from the worker's disk, so that one at a time is held

    def batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The batches in small pieces, but as they are where each opens several indexes."""
        return pieces(batches) if len(self.indexes) == 1 else batches

    def matches(self, texts: pa.Array, hasher: Hasher) -> Iterator[tuple[int, Index, tuple[int, int, float, int, int]]]:
        """(row, index, one of its matches) in the texts of a batch; with one index it goes slice by slice, else each index is opened once a batch."""
        some: list[tuple[int, np.ndarray, np.ndarray]] = []
        for lo, _, data, off in text_slices(texts):
            low = lowered(data)
            starts, ends, first = words(low, off, NOT_SPACE)
            some.append((lo, hasher.of(low, starts, ends), first))
            if len(self.indexes) == 1:
                yield from self._of(some)
                some = []
        if some:
            yield from self._of(some)

    def _of(self, some: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, Index, tuple[int, int, float, int, int]]]:
        for index in self:
            for lo, h, first in some:
                for m in index.matches(h, first):
                    yield lo + m[0], index, m


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, first_word, end_word for each document and item it holds; clean documents have no row."""
    parts = Parts(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in parts.batches(batches):
            ids = b.column("doc_id").to_pylist()
            rows = [(ids[row], index.ids[m[1]], *m[2:]) for row, index, m in parts.matches(b.column("text"), hasher)]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "item_id", "similarity", "first_word", "end_word"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, similarity double, first_word long, end_word long")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item."""
    parts = Parts(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in parts.batches(batches):
            ok = np.ones(b.num_rows, bool)
            ok[[row for row, _, _ in parts.matches(b.column("text"), hasher)]] = False
            yield b.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)

"""Best-fit packing of tokenised documents into sequences, improved by exchanges between underfull ones.

A document is its token ids and an end mark; only one longer than a sequence is cut, into pieces of which
the last may be shorter. Pieces are dealt by hash into groups of about GROUP. A task packs its group best
fit, longest first, and then searches locally: of two underfull sequences the emptier gives to the
fuller, by moving a piece, by exchanging one piece for one, two for one or one for two, whatever fills
the fuller one most without overflowing. As tokens then only go from emptier to fuller sequences, every
step increases the sum of squared fills, and the emptiest sequences run empty. The search ends at the
lower bound for the group's pieces, or when no exchange is left within its budget of EFFORT trials a
piece (a search could always go on; the budget bounds its work, not what is packed).

What a group leaves open, sequences with more than a 1 / CLOSED of room, is dealt anew with that of the
other groups, so each round has fewer pieces and groups, until one group is left or a round brings
no sequence more. No task holds more than a group, and texts are tokenised once and written down.

Defined cases: a null or empty text is the end mark alone; rows that repeat, or share a doc_id, are
packed each; a null doc_id stays null; a document of exactly one sequence is one piece; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut, reread
from .tokens import WordVocabulary, kept

CAPACITY, END = 4096, 1
#: Pieces of one group, trials of the search for each of them, and the share of a sequence that may stay free when it is closed.
GROUP, EFFORT, CLOSED = 20_000, 4, 256
#: Times that open sequences are dealt anew at most.
ROUNDS = 6

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECE}, row long, sequence_id long, offset long, open boolean"


def document_pieces(slices: Iterator[np.ndarray], capacity: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, crc32 of the ids) of each piece of a document given in slices."""
    start = length = crc = 0
    for ids in slices:
        while len(ids):
            some, ids = ids[: capacity - length], ids[capacity - length :]
            length, crc = length + len(some), zlib.crc32(some.astype("<u4").tobytes(), crc)
            if length == capacity:
                yield start, length, crc
                start, length, crc = start + length, 0, 0
    if length:
        yield start, length, crc


def tokenised(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """The pieces of docs(doc_id, text) in order of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = kept(("words", path), lambda: WordVocabulary(path))
        end = np.array([END], np.uint32)
        for b in batches:
            found: list[tuple] = []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
                slices = (s for part in (vocabulary.encode(text.as_py() or b""), [end]) for s in part)
                found += [(i, k, *p) for k, p in enumerate(document_pieces(slices, capacity))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that the pieces need at least: by their sum, and by those too long to share one with another of at least k tokens."""
    count = np.bincount(lengths, minlength=capacity + 1)
    many, total = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * np.arange(capacity + 1))])
    k, half = np.arange(capacity // 2 + 1), capacity // 2
    alone, large = many[-1] - many[capacity - k + 1], many[capacity - k + 1] - many[half + 1]
    room = large * capacity - (total[capacity - k + 1] - total[half + 1])
    small = total[half + 1] - total[k]
    return int((alone + large + np.maximum(0, -((room - small) // capacity))).max(initial=0))


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sequences as lists of places in `lengths`: longest first, each into the fullest sequence that it fits."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some sequence has room r
    for p in sorted(range(len(lengths)), key=lambda p: -lengths[p]):
        n = lengths[p]
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            rooms &= ~(1 << room) if not by_room[room] else -1
            bins[b].append(p)
        else:
            room, b = capacity, len(bins)
            bins.append([p])
        by_room[room - n].append(b)
        rooms |= 1 << room - n
    return bins


class Exchange:
    """Local search on sequences given as lists of pieces."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int) -> None:
        self.bins, self.lengths, self.capacity = bins, lengths, capacity
        self.fill = [sum(lengths[p] for p in b) for b in bins]

    def _by_length(self, b: int, most: int) -> dict[int, tuple[int, ...]]:
        """For each sum of one, or two, of the sequence's pieces such pieces."""
        one = {self.lengths[p]: p for p in self.bins[b]}
        out: dict[int, tuple[int, ...]] = {n: (p,) for n, p in one.items()}
        if most == 2:
            for p, q in combinations(self.bins[b] if len(self.bins[b]) <= 2 * len(one) else [*one.values()], 2):
                out.setdefault(self.lengths[p] + self.lengths[q], (p, q))
        return out

    def best(self, giver: int, taker: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
        """The pieces to give and to take back that fill the taker most; None if nothing fills it further."""
        room = self.capacity - self.fill[taker]
        ones, twos = self._by_length(giver, 1), self._by_length(giver, 2)
        back_one, back_two = self._by_length(taker, 1), self._by_length(taker, 2)
        found = (0, (), ())
        for gives, takes in ((twos, {0: ()} | back_one), (ones, back_two)):  # move, 1:1, 2:1; then 1:2
            sums = sorted(gives)
            for less, back in takes.items():
                at = bisect_right(sums, room + less)
                if at and sums[at - 1] - less > found[0]:
                    found = (sums[at - 1] - less, gives[sums[at - 1]], back)
                    if found[0] == room:
                        return found[1:]
        return found[1:] if found[0] else None

    def run(self, least: int, budget: int) -> None:
        """Exchanges until `least` sequences are left, nothing improves, or `budget` pairs were tried.

        The emptiest sequence gives to the others, fullest first, until it is empty or a turn changes nothing; then the next emptiest gives.
        """
        under = sorted((f, b) for b, f in enumerate(self.fill) if f < self.capacity)
        left, turn = sum(map(bool, self.bins)), 0
        while left > least and turn < len(under) - 1 and budget > 0:
            giver, changed = under[turn][1], False
            for f, taker in under[:turn:-1]:
                budget -= 1
                if budget < 0 or not self.bins[giver]:
                    break
                # equal or fuller than the giver, so every exchange increases the sum of squares
                if self.fill[taker] < self.fill[giver]:
                    break
                found = self.best(giver, taker)
                if found:
                    self._swap(giver, taker, *found)
                    changed = True
                    under.remove((f, taker))
                    if self.fill[taker] < self.capacity:
                        insort(under, (self.fill[taker], taker))
            if changed:
                under = [(f, b) for f, b in under if b != giver]
                if self.bins[giver]:
                    insort(under, (self.fill[giver], giver))
                else:
                    left -= 1
                turn = 0
            else:
                turn += 1

    def _swap(self, giver: int, taker: int, give: tuple[int, ...], back: tuple[int, ...]) -> None:
        self.bins[giver] = [p for p in self.bins[giver] if p not in give] + [*back]
        self.bins[taker] = [p for p in self.bins[taker] if p not in back] + [*give]
        moved = sum(self.lengths[p] for p in give) - sum(self.lengths[p] for p in back)
        self.fill[giver] -= moved
        self.fill[taker] += moved


def packed(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sequences of places in `lengths`, as few as the search finds."""
    search = Exchange(best_fit(lengths, capacity), lengths, capacity)
    search.run(lower_bound(np.array(lengths, np.int64), capacity), EFFORT * len(lengths))
    return [b for b in search.bins if b]


def _pack_groups(turn: int, capacity: int):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        # the same sequences whatever order the shuffle delivers
        group = group.sort_by("row")
        lengths = group["length"].to_pylist()
        bins = packed(lengths, capacity)
        # numbered by round, group and place
        first = turn << 56 | key[0].as_py() << 24
        sequence, offset, open_ = (np.zeros(len(lengths), kind) for kind in (np.int64, np.int64, bool))
        for b, pieces in enumerate(bins):
            at = 0
            for p in pieces:
                sequence[p], offset[p] = first + b, at
                at += lengths[p]
            open_[pieces] = (capacity - at) * CLOSED > capacity
        return group.select([*(c.split(" ")[0] for c in PIECE.split(", ")), "row"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).append_column("open", pa.array(open_))

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of docs(doc_id, text); `path` is the tokenizer's file."""
    pieces = reread(tokenised(docs, path, capacity), "pieces").withColumn("row", F.monotonically_increasing_id())
    full = F.col("length") == capacity
    # a piece that fills its sequence has nothing to exchange; its number is below all others'
    done = [pieces.where(full).withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long"))]
    rest, n, before = pieces.where(~full), None, None
    for turn in range(1, ROUNDS + 1):
        n = rest.count()
        groups = max(1, -(-n // GROUP))
        dealt = rest.withColumn("group", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(groups)).cast("long"))
        placed = cut(dealt.groupBy("group").applyInArrow(_pack_groups(turn, capacity), PLACED))
        bins = placed.where("open").agg(F.countDistinct("sequence_id").alias("n")).first()["n"]
        last = groups == 1 or turn == ROUNDS or before is not None and bins >= before
        done.append(placed if last else placed.where("not open"))
        if last:
            break
        before, rest = bins, placed.where("open").drop("sequence_id", "offset", "open")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    out = done[0].select(columns)
    for d in done[1:]:
        out = out.union(d.select(columns))
    return out

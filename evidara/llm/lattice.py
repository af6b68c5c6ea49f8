"""Language-model scores from a lattice over an existing subword vocabulary.

The vocabulary file's pieces and their order are given and never trained. No unigram vocabulary with
scores is at hand, the file is of byte pairs; so its order sets first weights, and one pass of expected counts over the training words (forward-backward over every
segmentation) turns them into probabilities. A text's probability is the product over its words of
the summed probability of all segmentations of the word into pieces, and of the end mark; the sum
is a log-space forward recursion. Beside it stands an add-one word model over the same training
texts.

Texts are handled in blocks of about BLOCK bytes. A block's words are told apart once; only its
distinct words, as 64-bit hashes with their counts, are shuffled to be summed with other blocks' and
come back as corpus counts. A common word is one row a block, never one row a place. Piece counts
are at most as many rows as the vocabulary has pieces.

Defined cases: null text counts as empty, which is the end mark alone; a null doc_id is a training
row; repeated rows count each; without training rows all counts are 0 and the first weights score;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut
from .textarrays import NOT_SPACE, Hasher, lowered, text_slices, words

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK = 24 << 20
#: Words of a block whose lattices are built at once.
CHUNK = 40_000
SMOOTHING = 0.1
#: Edges of one depth that are few.
FEW = 24
MARK = 0x20  # stands for the vocabulary's word mark; no word holds it


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces that lower-case words can hold, with a marked word begin as MARK, and their first log10 weights by rank; all 256 single bytes are among them."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, int] = {bytes([b]): model.get_piece_size() for b in range(256)}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)):
            body = piece.removeprefix("▁")
            if "▁" not in body and not any("A" <= c <= "Z" for c in body):
                name = (bytes([MARK]) if piece != body else b"") + body.encode()
                found[name] = min(i, found.get(name, i))
    pieces = list(found)
    weight = 1 / (np.array([found[p] for p in pieces]) + 10.0)
    return pieces, np.log10(weight / weight.sum())


def _order(depth: np.ndarray, z: np.ndarray, n: int) -> np.ndarray:
    """The edges by depth and then z, equal ones as they come; z is below n."""
    bits = len(z).bit_length()
    if not len(z) or (int(depth.max()) + 1) * n >> 63 - bits:
        return np.lexsort((z, depth))
    # one sort of plain numbers, each with its place in the low bits
    return np.sort((depth * n + z) << bits | np.arange(len(z))) & (1 << bits) - 1


class Lattice:
    """Finds the pieces at every place of many words and sums over all segmentations. Logarithms are of base 10."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.hasher = Hasher()
        data = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.array([len(p) for p in pieces])
        ends = np.cumsum(size)
        key = self.hasher.of(data, ends - size, ends)
        self.order = np.argsort(key)
        self.key, self.longest = key[self.order], int(size.max())
        # by the upper bits of a hash: whether a piece has them, the first of these pieces, and how many they are at most
        heads = np.bincount((key >> np.uint64(44)).astype(np.int64), minlength=1 << 20)
        self.some, self.first, self.most = heads > 0, np.cumsum(heads) - heads, int(heads.max())
        # no piece goes on where no prefix of one stands
        self.opens = np.zeros(1 << 20, bool)
        for n in range(1, self.longest):
            at = (ends - size)[size > n]
            self.opens[self.hasher.of(data, at, at + n) >> np.uint64(44)] = True

    def edges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from byte, to byte, piece) of every piece inside the words, which follow each other without gaps."""
        stop = np.repeat(ends, ends - starts)
        place = np.arange(len(data))
        hashes = self.hasher.runs(data)
        parts = []
        for n in range(1, self.longest + 1):
            at = place[place + n <= stop[place]]
            if not len(at):
                break
            key = hashes(at, at + n)
            head = key >> np.uint64(44)
            place, may = at[self.opens[head]], self.some[head]
            at, key = at[may], key[may]
            i = self.first[head[may]]
            for _ in range(self.most - 1):
                i = np.minimum(i + (self.key[i] < key), len(self.key) - 1)
            hit = self.key[i] == key
            parts.append((at[hit], np.full(hit.sum(), n), self.order[i[hit]]))
        a = np.concatenate([p[0] for p in parts])
        return a, a + np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])

    @staticmethod
    def _sums(a: np.ndarray, z: np.ndarray, lp: np.ndarray, starts: np.ndarray, depth: np.ndarray, n: int) -> np.ndarray:
        """Log sums of the paths from each word's start to each place, by the depth of the edges' ends."""
        f = np.full(n, -np.inf)
        f[starts] = 0.0
        order = _order(depth, z, n)
        a, z, lp, depth = a[order], z[order], lp[order], depth[order]
        bounds = np.flatnonzero(np.concatenate([[True], depth[1:] != depth[:-1]])) if len(depth) else np.zeros(0, int)
        ends = np.append(bounds[1:], len(depth)).astype(int)
        many = np.flatnonzero(ends - bounds > FEW)
        tail = int(many[-1]) + 1 if len(many) else 0
        for i, j in zip(bounds[:tail], ends[:tail], strict=True):
            value, to = f[a[i:j]] + lp[i:j], z[i:j]
            first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            top = np.maximum.reduceat(value, first)
            f[to[first]] = top + np.log10(np.add.reduceat(10.0 ** (value - np.repeat(top, np.diff(np.append(first, j - i)))), first))
        if tail < len(bounds):  # what the longest words have left: few edges a depth, for which plain numbers do
            begin = bounds[tail]
            sums = dict(zip(a[begin:].tolist(), f[a[begin:]].tolist(), strict=True))
            todo, ends = zip(a[begin:].tolist(), z[begin:].tolist(), lp[begin:].tolist(), strict=True), []
            for to, some in itertools.groupby(todo, key=lambda e: e[1]):
                value = [sums[at] + p for at, _, p in some]
                top = max(value)
                sums[to] = top + math.log10(sum(10.0 ** (v - top) for v in value)) if top > -math.inf else top
                ends.append(to)
            f[ends] = [sums[to] for to in ends]
        return f

    def run(self, data: np.ndarray, off: np.ndarray, weight: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """log10 probabilities of the words data[off[i]:off[i + 1]], and the expected counts of the pieces, each word `counts` times."""
        out, expected = np.zeros(len(off) - 1), np.zeros(len(weight))
        for lo in range(0, len(off) - 1, CHUNK):
            hi = min(lo + CHUNK, len(off) - 1)
            size = np.diff(off[lo : hi + 1]) + 1
            ends = np.cumsum(size)
            starts = ends - size
            marked = np.full(ends[-1], MARK, np.uint8)
            body = np.ones(len(marked), bool)
            body[starts] = False
            marked[body] = data[off[lo] : off[hi]]
            a, z, piece = self.edges(marked, starts, ends)
            # places: one more than bytes for each word
            word = np.repeat(np.arange(hi - lo), size)
            na, nz = a + word[a], z + word[a]
            s, e = starts + np.arange(hi - lo), ends + np.arange(hi - lo)
            lp = weight[piece]
            f = self._sums(na, nz, lp, s, nz - s[word[a]], int(e[-1]) + 1)
            out[lo:hi] = f[e]
            if counts is not None:
                b = self._sums(nz, na, lp, e, e[word[a]] - na, int(e[-1]) + 1)
                share = 10.0 ** (f[na] + lp + b[nz] - f[e][word[a]]) * counts[lo:hi][word[a]]
                expected += np.bincount(piece, share, len(weight))
        return out, expected


BLOCKS = "block long, payload binary, raw long, hashes array<long>, train array<long>, pieces array<int>, expected array<double>, train_docs long"


def _pack(*arrays: np.ndarray) -> tuple[bytes, int]:
    """The arrays in one compressed run of bytes, and its length before."""
    head = np.array([len(arrays), *(x.nbytes for x in arrays)], np.int64)
    raw = b"".join([head.tobytes(), *(x.tobytes() for x in arrays)])
    return pa.compress(raw, codec="zstd", asbytes=True), len(raw)


def _unpack(payload: bytes, raw: int, *kinds: type) -> list[np.ndarray]:
    data = pa.decompress(payload, decompressed_size=raw, codec="zstd", asbytes=True)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.int64, n, 8)
    ends = 8 * (n + 1) + np.cumsum(sizes)
    return [np.frombuffer(data[e - s : e], k) for s, e, k in zip(sizes, ends, kinds, strict=True)]


def _blocks(pieces: list[bytes], weight: np.ndarray):
    """Rows of BLOCKS; the payload holds doc ids (and which are null), held-out marks, words a document, the words' numbers, and the block's distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, hasher = Lattice(pieces), Hasher()
        part = TaskContext.get().partitionId() << 32
        kept: list[tuple] = []
        held_bytes = 0

        def block() -> pa.RecordBatch:
            nonlocal part, kept, held_bytes
            ids, null, held, n, h, text, size = (np.concatenate([k[i] for k in kept]) for i in range(7))
            kept, held_bytes = [], 0
            name, first, number, total = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            train = np.bincount(number, np.repeat(~held, n), len(name)).astype(np.int64)
            # frequent words get small numbers, which pack better
            order = np.argsort(-total, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            name, first, train = name[order], first[order], train[order]
            begin = np.cumsum(size) - size
            length = size[first]
            off = np.concatenate([[0], np.cumsum(length)])
            body = text[np.repeat(begin[first] - off[:-1], length) + np.arange(off[-1])]
            learn = np.flatnonzero(train)
            lo = np.concatenate([[0], np.cumsum(length[learn])])
            _, expected = lattice.run(body[np.repeat(off[learn] - lo[:-1], length[learn]) + np.arange(lo[-1])], lo, weight, train[learn])
            some = np.flatnonzero(expected)
            payload, raw = _pack(ids, null, held, n.astype(np.int64), rank[number], body, off)
            part += 1
            row = [part - 1, payload, raw, name.view(np.int64), train, some.astype(np.int32), expected[some], int((~held).sum())]
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["block", "payload", "raw", "hashes", "train", "pieces", "expected", "train_docs"])

        for b in batches:
            ids = b.column("doc_id").cast(pa.int64())
            null = np.asarray(ids.is_null())
            plain = ids.fill_null(0).to_numpy()
            held = np.asarray(b.column("held_out"))
            for lo, hi, data, off in text_slices(b.column("text")):
                low = lowered(data)
                starts, ends, first = words(low, off, NOT_SPACE)
                kept.append((plain[lo:hi], null[lo:hi], held[lo:hi], np.diff(first), hasher.of(low, starts, ends), low[NOT_SPACE[low]], ends - starts))
                held_bytes += len(data)
                if held_bytes >= BLOCK:
                    yield block()
        if kept:
            yield block()

    return run


def _score(pieces: list[bytes], weight: np.ndarray, end: float, tokens: int, distinct: int, end_count: int):
    """Scores of one block's documents; the right side brings the corpus counts of its words."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        ids, null, held, n, number, body, off = _unpack(left["payload"][0].as_py(), left["raw"][0].as_py(), np.int64, bool, bool, np.int64, np.int32, np.uint8, np.int64)
        count = np.zeros(len(off) - 1, np.int64)
        count[right["at"].to_numpy()] = right["c"].to_numpy()
        base = np.log10((count + 1) / (tokens + distinct + 1))
        lp, _ = Lattice(pieces).run(body, off, weight)
        at = np.concatenate([[0], np.cumsum(n)])

        def summed(v: np.ndarray) -> np.ndarray:
            out, some = np.zeros(len(n), v.dtype), np.flatnonzero(n)
            if len(some):
                out[some] = np.add.reduceat(v[number], at[some])
            return out

        columns = [
            pa.array(ids, pa.int64(), mask=null),
            pa.array(held),
            pa.array(n + 1),
            pa.array(summed((count > 0).astype(np.int64)) + int(end_count > 0)),
            pa.array(np.full(len(n), tokens)),
            pa.array(summed(base) + np.log10((end_count + 1) / (tokens + distinct + 1))),
            pa.array(summed(lp) + end),
        ]
        return pa.Table.from_arrays(columns, schema=schema)

    return run


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def score(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs(doc_id, text)."""
    pieces, weight = vocabulary(path)
    blocks = cut(docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(_blocks(pieces, weight), BLOCKS))
    spread = blocks.select("block", F.posexplode(F.arrays_zip("hashes", "train")).alias("at", "w")).select("block", "at", F.col("w.hashes").alias("h"), F.col("w.train").alias("n"))
    counts = cut(spread.groupBy("h").agg(F.sum("n").alias("c")))
    seen = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    ends = blocks.agg(F.coalesce(F.sum("train_docs"), F.lit(0)).alias("n")).first()["n"]
    # at most a row for each piece of the vocabulary
    learned = blocks.select(F.explode(F.arrays_zip("pieces", "expected")).alias("x")).groupBy(F.col("x.pieces").alias("piece")).agg(F.sum("x.expected").alias("n")).collect()
    if learned:
        expected = np.full(len(pieces), SMOOTHING)
        for r in learned:
            expected[r["piece"]] += r["n"]
        total = expected.sum() + ends + SMOOTHING
        weight, end = np.log10(expected / total), float(np.log10((ends + SMOOTHING) / total))
    else:
        end = float(np.log10(0.5))
    known = spread.join(counts.where("c > 0"), "h").select(F.col("block").alias("of_block"), "at", "c")
    run = _score(pieces, weight, end, int(seen["n"] + ends), int(seen["v"] + (ends > 0)), int(ends))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.select("block", "payload", "raw").groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(run, schema)

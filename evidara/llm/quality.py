"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage becomes a vector of shape features,
is encoded by one tanh layer, and gated attention weights the encodings into the document's, which a
logistic unit scores. Only document labels are learned from. Scoring covers every passage of the
whole text, one task per input partition; nothing is shuffled.

Defined cases: null text counts as empty; an empty text is one passage of zeros and is scored like
any other; a document labelled more than once takes its smallest label, null labels are ignored;
without two classes among the usable labels every score is the share of label 1 (1 without labels).
Extra columns are ignored, repeated rows are scored each on its own, an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import pieces, sampled
from .textarrays import NOT_SPACE, Hasher, byte_set, lowered, text_slices, words

PASSAGE = 48
#: About so many labelled documents at most train the model, those with the smallest hashes; of one with more than MAX_PASSAGES passages so many, spread over the whole text.
MAX_TRAIN, MAX_PASSAGES = 4_000, 2_000
HIDDEN, ATTENTION, RATE, DECAY = 16, 8, 0.02, 1e-4
#: Documents of a step, passes over the documents, and passes without a lower loss after which learning ends.
BATCH, EPOCHS, PATIENCE = 256, 60, 8
THRESHOLD = 0.7

CLASSES = [
    byte_set((65, 90)),  # capitals
    byte_set((97, 122)),  # small letters
    byte_set((48, 57)),  # digits
    byte_set((128, 255)),  # bytes of other letters
    byte_set((33, 33), (63, 63)),  # ! ?
    byte_set((44, 44), (46, 46), (58, 59)),  # , . : ;
    byte_set((35, 38), (42, 43), (60, 62), (64, 64), (91, 96), (123, 126)),  # symbols
    byte_set((34, 34), (39, 41), (45, 45), (47, 47)),  # quotes, brackets, dashes
]
N_FEATURES = len(CLASSES) + 6


def passages(data: np.ndarray, off: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of the passages, and each document's first passage (documents + 1 values)."""
    starts, ends, first = words(data, off, NOT_SPACE)
    n = np.diff(first)
    count = np.maximum(1, -(-n // PASSAGE))
    begin = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    a = first[doc] + (np.arange(begin[-1]) - begin[doc]) * PASSAGE
    z = np.minimum(a + PASSAGE, first[doc + 1])
    size = (z - a).astype(np.float64)
    x = np.zeros((len(doc), N_FEATURES))
    if len(starts):
        some = z > a
        lo, hi = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        lo[some], hi[some] = starts[a[some]], ends[z[some] - 1]
        chars = np.maximum(hi - lo, 1)
        total = lambda v, i, j: (c := np.concatenate([[0], np.cumsum(v, dtype=np.int64)]))[j] - c[i]
        for k, table in enumerate(CLASSES):
            x[:, k] = total(table[data], lo, hi) / chars
        h = hasher.of(lowered(data), starts, ends)
        inner = np.ones(len(h), bool)
        inner[first[:-1][first[:-1] < len(h)]] = False
        same = np.concatenate([[False], h[1:] == h[:-1]]) & inner
        words_n = np.maximum(size, 1)
        x[:, len(CLASSES)] = total(same, a, z) / words_n
        length = ends - starts
        mean = total(length, a, z) / words_n
        x[:, len(CLASSES) + 1] = mean
        x[:, len(CLASSES) + 2] = np.sqrt(np.maximum(0, total(length * length, a, z) / words_n - mean**2))
        x[:, len(CLASSES) + 3] = total(length == 1, a, z) / words_n
        x[:, len(CLASSES) + 4] = total(data == 10, lo, hi) / words_n
    x[:, len(CLASSES) + 5] = np.log1p(size)
    return x, begin


@dataclass
class Model:
    """Parameters of the encoder, the gated attention and the logistic unit."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, begin: np.ndarray) -> dict[str, np.ndarray]:
        p, v = self.p, {}
        v["x"] = np.clip((x - self.mean) / self.scale, -8, 8)
        v["h"] = np.tanh(v["x"] @ p["w"] + p["wb"])
        v["t"], v["g"] = np.tanh(v["h"] @ p["v"]), 1 / (1 + np.exp(-(v["h"] @ p["u"])))
        e = (v["t"] * v["g"]) @ p["a"]
        doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        e = np.exp(e - np.maximum.reduceat(e, begin[:-1])[doc])
        v["doc"], v["att"] = doc, e / np.add.reduceat(e, begin[:-1])[doc]
        v["z"] = np.add.reduceat(v["att"][:, None] * v["h"], begin[:-1], axis=0)
        v["y"] = 1 / (1 + np.exp(-np.clip(v["z"] @ p["c"] + p["cb"], -30, 30)))
        return v

    def gradients(self, v: dict[str, np.ndarray], begin: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, doc = self.p, v["doc"]
        d = (v["y"] - y) / len(y)
        dz = d[:, None] * p["c"]
        da = (dz[doc] * v["h"]).sum(1)
        de = v["att"] * (da - np.add.reduceat(v["att"] * da, begin[:-1])[doc])
        dt, dg = de[:, None] * p["a"] * v["g"] * (1 - v["t"] ** 2), de[:, None] * p["a"] * v["t"] * v["g"] * (1 - v["g"])
        dh = (v["att"][:, None] * dz[doc] + dt @ p["v"].T + dg @ p["u"].T) * (1 - v["h"] ** 2)
        g = {"w": v["x"].T @ dh, "wb": dh.sum(0), "v": v["h"].T @ dt, "u": v["h"].T @ dg, "a": (v["t"] * v["g"]).T @ de, "c": v["z"].T @ d, "cb": d.sum()}
        return {k: x + DECAY * p[k] for k, x in g.items()}


def fit(x: np.ndarray, begin: np.ndarray, y: np.ndarray) -> Model:
    """Adam over batches of a bounded set of bags, from a fixed start in a fixed order; the pass with the lowest loss counts."""
    r = np.random.default_rng(5)
    draw = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
    m = Model(x.mean(0), x.std(0) + 1e-6, {"w": draw(N_FEATURES, HIDDEN), "wb": np.zeros(HIDDEN), "v": draw(HIDDEN, ATTENTION), "u": draw(HIDDEN, ATTENTION), "a": draw(ATTENTION), "c": draw(HIDDEN), "cb": np.zeros(())})
    one, two = ({k: np.zeros_like(v) for k, v in m.p.items()} for _ in range(2))
    best, least, worse, t = dict(m.p), np.inf, 0, 0
    for epoch in range(EPOCHS):
        order, loss, rate = r.permutation(len(y)), 0.0, RATE * 0.95**epoch
        for lo in range(0, len(y), BATCH):
            some = order[lo : lo + BATCH]
            n = begin[some + 1] - begin[some]
            at = np.concatenate([[0], np.cumsum(n)])
            rows = np.repeat(begin[some] - at[:-1], n) + np.arange(at[-1])
            v = m.forward(x[rows], at)
            loss -= np.log(np.where(y[some] == 1, v["y"], 1 - v["y"])).sum()
            t += 1
            for k, g in m.gradients(v, at, y[some]).items():
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.999 * two[k] + 0.001 * g * g
                m.p[k] = m.p[k] - rate * (one[k] / (1 - 0.9**t)) / (np.sqrt(two[k] / (1 - 0.999**t)) + 1e-8)
        if loss < least - 1e-3 * len(y):
            best, least, worse = dict(m.p), loss, 0
        elif (worse := worse + 1) == PATIENCE:
            break
        elif loss < least:
            best, least = dict(m.p), loss
    return Model(m.mean, m.scale, best)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for b in pieces(batches):
        y = b.column("y").to_numpy(zero_copy_only=False)
        for lo, hi, data, off in text_slices(b.column("text")):
            x, begin = passages(data, off, hasher)
            spread = lambda i, j: np.arange(i, j) if j - i <= MAX_PASSAGES else i + np.arange(MAX_PASSAGES) * (j - i) // MAX_PASSAGES
            bag = [x[spread(i, j)].astype(np.float32).tobytes() for i, j in zip(begin, begin[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(bag, pa.binary()), pa.array(y[lo:hi], pa.int32())], ["bag", "y"])


def train(docs: DataFrame, labels: DataFrame) -> Model | float:
    """The model, or the share of label 1 where the usable labels don't hold two classes."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    chosen = usable.where(sampled("doc_id", MAX_TRAIN / max(1, usable.count())))
    # about MAX_TRAIN rows of two numbers: safe to broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y").mapInArrow(_bags, "bag binary, y int").collect()
    y = np.array([r["y"] for r in rows], float)
    if len(set(y)) < 2:
        return float(y.mean()) if len(y) else 1.0
    order = sorted(range(len(rows)), key=lambda i: (bytes(rows[i]["bag"]), rows[i]["y"]))
    bags = [np.frombuffer(rows[i]["bag"], np.float32).reshape(-1, N_FEATURES).astype(float) for i in order]
    return fit(np.concatenate(bags), np.concatenate([[0], np.cumsum([len(x) for x in bags])]), y[order])


def scored(docs: DataFrame, model: Model | float, name: str = "score") -> DataFrame:
    """All columns of docs and, under a name that they don't have yet, the probability of label 1."""
    schema = docs.select("*", F.lit(0.0).alias(name)).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in pieces(batches):
            out = np.full(b.num_rows, model if isinstance(model, float) else 0.0)
            if isinstance(model, Model):
                for lo, hi, data, off in text_slices(b.column("text")):
                    x, begin = passages(data, off, hasher)
                    out[lo:hi] = model.forward(x, begin)["y"]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, name])

    return docs.mapInArrow(score, schema)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the classifier does not reject."""
    name = next(n for n in (f"score_{k}" for k in itertools.count()) if n not in docs.columns)
    return scored(docs, train(docs, labels), name).where(F.col(name) >= THRESHOLD).select(*docs.columns)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    wanted = docs.select("doc_id", "text")
    # the texts stay behind: what leaves Python again is a number for each row
    return scored(wanted, train(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""The lattice's edges against plain Python, and the places that are looked at for them."""

import random

import numpy as np

from evidara.llm import lattice

PIECES = [bytes([b]) for b in range(256)] + [b" a", b" an", b"an", b"ana", b"nan", b"banana", b"abcdefghij", "é".encode(), "aé".encode()]


def some_words(r):
    found = ["".join(r.choice(["a", "n", "b", "an", "bana", "abcdefghi", "j", "é", "x"]) for _ in range(r.randint(1, 30))).encode() for _ in range(200)]
    size = np.array([len(w) for w in found])
    return found, np.frombuffer(b"".join(found), np.uint8), np.cumsum(size) - size, np.cumsum(size)


def test_edges_equal_plain_python_and_hash_no_place_that_no_piece_goes_on_from():
    found, data, starts, ends = some_words(random.Random(1))
    lat = lattice.Lattice(PIECES)
    hashed, runs = [], lat.hasher.runs

    def counted(data):
        of = runs(data)
        return lambda a, z: hashed.append(len(a)) or of(a, z)

    lat.hasher.runs = counted
    a, z, piece = lat.edges(data, starts, ends)
    number = {p: i for i, p in enumerate(PIECES)}
    want = [(lo + i, lo + j, number[w[i:j]]) for w, lo in zip(found, starts.tolist(), strict=True) for i in range(len(w)) for j in range(i + 1, min(len(w), i + 10) + 1) if w[i:j] in number]
    assert sorted(zip(a.tolist(), z.tolist(), piece.tolist(), strict=True)) == sorted(want)
    heads = {p[:n] for p in PIECES for n in range(1, len(p))}
    assert sum(hashed) < 1.01 * (len(data) + sum(w[i:j] in heads for w in found for i in range(len(w)) for j in range(i + 1, min(len(w) - 1, i + 9) + 1)))


def test_edges_are_put_in_order_as_by_depth_then_end():
    r = np.random.default_rng(2)
    for n, deep in ((5, 3), (2_000, 40), (1_000, 1 << 50)):
        depth, z = r.integers(0, deep, 3_000), r.integers(0, n, 3_000)
        assert (lattice._order(depth, z, n) == np.lexsort((z, depth))).all()
    assert len(lattice._order(np.zeros(0, np.int64), np.zeros(0, np.int64), 1)) == 0

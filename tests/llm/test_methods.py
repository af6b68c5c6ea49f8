"""The methods' own part of each operator against plain Python: terms, ranges, trees, lattices, tilts, templates, windows, groups."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidara.llm import decontaminate, embeddings, lattice, licenses, linededup, mixing, neardup, pii, quality, urls
from evidara.llm.tables import bit_table, may_hold, sampled

from .test_ops import WORD, by_id, plain_entities, smallest_reachable


def test_disclosing_terms_equal_plain_python(spark):
    r = random.Random(7)
    names = ["Quillon", "Berwick", "Tamsin", "z" * 250, "éàü", "ab"]
    who = {f"{n}@x{k}.example.com": names[k % len(names)] for k, n in enumerate("pqrstuv")}
    texts = []
    for k in range(160):
        words = [r.choice(names) if r.random() < 0.004 else r.choice(["alpha", "beta", "gamma", "delta", "Omega"]) for _ in range(r.randint(0, 30))]
        if k % 2:
            mail = r.choice(list(who))
            words[r.randint(0, len(words)) : 0] = [who[mail], *r.choices(["alpha", "beta"], k=r.choice([0, 3, 9])), mail]
        texts.append(" ".join(words))
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    both, with_entity, with_term = Counter(), Counter(), Counter()
    for t in texts:
        near = set()
        spans = [s for kind in plain_entities(t).values() for s in kind]
        for a, b in spans:
            words = [m.span() for m in term.finditer(t)]
            window = [w for w in words if w[1] <= a][-8:] + [w for w in words if w[0] >= b][:8]
            near |= {(t[a:b], low(t[s:e])) for s, e in window if e - s >= 3 and not any(s < z and y < e for y, z in spans)}
        both.update(near)
        with_entity.update({e for e, _ in near})
        with_term.update({w for w in term.findall(low(t)) if len(w) >= 3})
    want, n = {}, len(texts)
    for (e, w), k in both.items():
        own = math.log2(n / with_entity[e])
        if k >= pii.MIN_SUPPORT and own > 0:
            want[w] = max(want.get(w, -9), math.log2(k * n / (with_entity[e] * with_term[w])) / own)
    want = {w: "remove" if x >= pii.REMOVE else "generalise" for w, x in want.items() if x >= pii.GENERALISE}
    got = pii.disclosing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {g["term"]: g["action"] for g in got} == want and want


def test_a_long_word_does_not_close_the_window(spark):
    rows = [(i, f"Quillon {'y' * 250} bob@corp.example.com {i}") for i in range(3)] + [(9 + i, f"nothing {i}") for i in range(20)]
    got = by_id(pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all("Quillon" not in got[i]["text"] and "yyy" not in got[i]["text"] for i in range(3))


def test_dense_groups_of_vectors_equal_brute_force(spark, monkeypatch):
    """Groups of near copies around the threshold, more vectors of a cell than one tile takes, and exact copies."""
    monkeypatch.setattr(embeddings, "TILE", 60)
    monkeypatch.setattr(embeddings, "ROWS", 16)
    r = np.random.default_rng(4)
    heads = r.normal(size=(12, 40))
    x = heads[r.integers(0, 12, 700)] + r.normal(size=(700, 40)) * r.uniform(0.02, 0.35, (700, 1))
    x = np.concatenate([x, x[:60] * 3]).astype(np.float32)
    label = np.concatenate([r.integers(0, 2, 700), np.zeros(60, int)])
    label[700:] = label[:60]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    want = smallest_reachable(range(760), [(a, b) for a, b in np.argwhere(near).tolist() if a < b])
    rows = [(k, x[k].tolist(), int(label[k])) for k in range(760)]
    got = by_id(embeddings.groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), 0.93), "vec_id")
    assert {k: (g["n_links"], g["component_id"]) for k, g in got.items()} == {k: (int(near[k].sum()), want[k]) for k in range(760)}


def test_pivots_tell_clusters_apart():
    r = np.random.default_rng(1)
    heads = r.normal(size=(60, 64))
    x = heads[r.integers(0, 60, 3000)] + 0.02 * r.normal(size=(3000, 64))
    spaces = embeddings.Subspaces(list(x), 0.93)
    y, met = spaces.coordinates(x), 0
    for k, (i, j) in enumerate(spaces.of(64)[1]):
        home, also = spaces.visits(64, k, y[:, i:j])
        size = np.bincount(home, minlength=also.shape[1])
        met += int((size * (size - 1) // 2 + size * also.sum(0)).sum())
    assert met < 0.5 * 3000 * 2999 / 2 and all(len(p) > 1 for p in spaces.of(64)[3])


def test_trees_judge_hosts_that_they_have_not_seen(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(4, 8)))
    bad = lambda host: f"http://{host}/{r.randint(10**9, 10**12)}/{r.randint(10**6, 10**9)}?{'&'.join(f'{word()}={r.randint(0, 10**6)}' for _ in range(5))}"
    good = lambda host, path="": f"http://{host}/{path}{word()}/{word()}"
    rows = [bad(f"{word()}.net") for _ in range(150)] + [good(f"{word()}.org", "fr/") for _ in range(150)]
    other = [(bad if k % 2 else good)(f"{word()}{k}.io") for k in range(200)]
    pages = spark.createDataFrame(list(enumerate(rows + other)), "page_id long, url string")
    got = by_id(urls.judge(pages), "page_id")
    assert all(got[k]["rule"] in ("net/", "org/fr/") for k in range(300)) and all(got[k]["rule"] is None for k in range(300, 500))
    assert sum((got[300 + k]["verdict"] == "block") == bool(k % 2) for k in range(200)) >= 190


def test_lattice_scores_whole_documents(spark):
    """Expected counts and scores by sums over places in plain Python."""
    texts = {1: "the cat sat on the mat", 2: "The dog, the CAT!", 3: "", 4: None, 5: "zxq überhaupt the", 6: "mat mat dog"}
    held = {i: __import__("zlib").crc32(str(i).encode()) % 7 == 2 for i in texts}
    pieces, weight = lattice.vocabulary(lattice.VOCABULARY)
    place, longest = {p: k for k, p in enumerate(pieces)}, max(map(len, pieces))
    low = lambda t: (t or "").encode().lower()
    words = {i: [bytes([lattice.MARK]) + w for w in re.findall(rb"[^\x20\x09-\x0D]+", low(t))] for i, t in texts.items()}

    def sums(w, p):
        f, b = [1.0] + [0.0] * len(w), [0.0] * len(w) + [1.0]
        parts = [(i, j, place[w[i:j]]) for i in range(len(w)) for j in range(i + 1, min(len(w), i + longest) + 1) if w[i:j] in place]
        for i, j, k in parts:
            f[j] += f[i] * p[k]
        for i, j, k in reversed(parts):
            b[i] += b[j] * p[k]
        return f, b, parts

    first, expected = 10.0**weight, defaultdict(float)
    for i, ws in words.items():
        for w in ws if not held[i] else []:
            f, b, parts = sums(w, first)
            for a, z, k in parts:
                expected[k] += f[a] * first[k] * b[z] / f[-1]
    ends = sum(not h for h in held.values())
    total = sum(expected.values()) + lattice.SMOOTHING * len(pieces) + ends + lattice.SMOOTHING
    final = np.full(len(pieces), lattice.SMOOTHING)
    for k, v in expected.items():
        final[k] += v
    got = by_id(lattice.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    for i, ws in words.items():
        want = sum(math.log10(sums(w, final / total)[0][-1]) for w in ws) + math.log10((ends + lattice.SMOOTHING) / total)
        assert got[i]["held_out"] == held[i] and math.isclose(got[i]["score"], want, rel_tol=1e-9)


def test_copies_follow_the_tilted_rates(spark):
    r = random.Random(9)
    rows = [(k, " ".join(["w"] * r.randint(1, 60)), r.choice("aab")) for k in range(400)] + [(400 + k, "w " * 5, "c") for k in range(4)]
    got = by_id(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    by = defaultdict(list)
    for g in got.values():
        by[g["source"]].append(g)
    for source in by.values():
        size, target = np.array([g["size"] for g in source], float), source[0]["target"]
        lo, hi = -5.0, 5.0
        for _ in range(200):
            mid = (lo + hi) / 2
            over = (np.minimum(3, np.exp(np.minimum(mid * size, 5))) * size).sum() > target
            lo, hi = (lo, mid) if over else (mid, hi)
        rate = np.minimum(3, np.exp(np.minimum(lo * size, 5)))
        copies = np.array([g["copies"] for g in source])
        assert (np.abs(copies - rate) < 1.001).all() and abs((copies * size).sum() - target) <= size.max()
    assert {g["copies"] for g in by["c"]} == {3}


def test_mix_that_does_not_converge_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROUNDS", 1)
    rows = [(k, "w " * (k + 1), "ab"[k % 2]) for k in range(40)]
    with pytest.raises(ArithmeticError, match="Newton"):
        mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_template_labels_equal_brute_force(spark):
    r = random.Random(6)
    parsed = [(label, words, must) for label, words, must in licenses._parsed()]
    filler = ["lorem", "ipsum", "dolor", "the", "of", "this", "license", "software", "and", "permission"]
    texts = ["", "nothing here"]
    for k in range(90):
        out = r.choices(filler, k=r.randint(0, 40))
        for _ in range(r.choice([1, 1, 2])):
            words = list(r.choice(parsed)[1])
            for _ in range(r.choice([0, 0, 1, 3, len(words) // 3])):  # other words in some places
                words[r.randrange(len(words))] = r.choice(filler)
            if r.random() < 0.2:
                words = words[r.randint(1, 4) :]
            out += words + r.choices(filler, k=r.randint(0, 20))
        texts.append(r.choice([" ", "\n", ", "]).join(out))
    files = [licenses._split(t) for t in texts]
    vocabulary = {w for _, words, _ in parsed for w in words}
    weight = {w: math.log((len(files) + 1) / (sum(w in set(f) for f in files) + 1)) for w in vocabulary}
    got = by_id(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    found = 0
    for i, f in enumerate(files):
        labels, best = set(), 0.0
        for label, words, must in parsed:
            total = sum(weight[w] for w in words)
            for s in range(-len(words), len(f)):
                same = [0 <= s + k < len(f) and f[s + k] == w for k, w in enumerate(words)]
                if all(x or not m for x, m in zip(same, must, strict=True)):
                    share = sum(weight[w] for w, x in zip(words, same, strict=True) if x) / total
                    if share >= licenses.MIN_SHARE:
                        labels.add(label)
                        best = max(best, share)
        assert set(got[i]["template_labels"]) == labels
        assert math.isclose(got[i]["score"], 1.0 if got[i]["places"] else best, abs_tol=1e-9)
        found += len(labels)
    assert found > 60


def test_words_put_in_or_left_out_of_items_are_found(spark):
    """Copies of items with one to three words changed, put in or left out, whose own similarity reaches 0.8 by brute force."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    items = [[word() for _ in range(r.randint(25, 59))] for _ in range(30)]
    grams = lambda ws: Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4))
    rows, want = [], {"change": set(), "insert": set(), "delete": set()}
    for kind in want:
        for i, ws in enumerate(items):
            for _ in range(6):
                copy = list(ws)
                for _ in range(r.randint(1, 3)):
                    at = r.randrange(len(copy))
                    copy[at : at + (kind != "insert")] = [] if kind == "delete" else [word()]
                a, b = grams(ws), grams(copy)
                if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                    want[kind].add((len(rows), i))
                rows.append((len(rows), " ".join([word() for _ in range(r.randint(0, 40))] + copy + [word() for _ in range(40)])))
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(items)], "item_id long, text string")
    found = {(g["doc_id"], g["item_id"]) for g in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    for kind, pairs in want.items():
        assert len(pairs) > 20 and len(pairs & found) >= 0.95 * len(pairs), (kind, len(pairs), len(pairs & found))


def test_parts_of_the_benchmark_find_the_same(spark, monkeypatch):
    r = random.Random(8)
    word = lambda: r.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"])
    items = [(i, " ".join(word() for _ in range(r.randint(20, 40)))) for i in range(24)]
    docs = [(k, f"{word()} {items[k % 24][1].replace('beta', 'xi', 1)} {word()}") for k in range(48)] + [(99, "clean"), (100, None)]
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = {tuple(x) for x in decontaminate.contaminated(docs, bench).collect()}
    left = {x["doc_id"] for x in decontaminate.clean(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "PART", 700)
    assert {tuple(x) for x in decontaminate.contaminated(docs, bench).collect()} == one and len(one) >= 24
    assert {x["doc_id"] for x in decontaminate.clean(docs, bench).collect()} == left == {99, 100} | (set(range(48)) - {x[0] for x in one})


def test_blocks_of_words_find_the_same(monkeypatch):
    """Candidates equal those of every window taken by itself, however the words are cut into blocks."""
    r, hasher = random.Random(4), decontaminate.Hasher()
    word = lambda: r.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 7, 20, 33, 60])]
    of = [decontaminate.words_and_shingles(t, hasher) for _, t in items]
    known, holders = np.unique(np.concatenate([np.unique(s) for _, s in of]), return_counts=True)
    index = decontaminate.Index(items, len(items), known, holders)
    rows = [of[2][0], of[0][0][:0], np.concatenate([of[1][0], of[4][0], of[3][0][:9]]), of[0][0][:1], of[3][0], of[0][0][:0]]
    h, first = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    want = set()
    for row, x in enumerate(rows):
        for w, (prints, who, _) in index.tables.items():
            for place in range(0, len(x) - w + 1, decontaminate.stride(w)):
                f = decontaminate.BitSums(x, w).fingerprints(np.array([place]), w)
                near = np.flatnonzero(np.bitwise_count(f ^ prints) <= decontaminate.RADIUS)
                want |= {(row, int(k), place - int(at)) for k, at in who[near]}
    assert len({x[1] for x in want}) == 5
    for block in (1, 5, 64, 1 << 15):
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        assert index.candidates(h, first).tolist() == [list(x) for x in sorted(want)]


def test_gradients_of_the_attention_model():
    r = np.random.default_rng(0)
    x, begin, y = r.normal(size=(9, quality.N_FEATURES)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    d = lambda *s: r.normal(0, 0.5, s)
    p = {"w": d(quality.N_FEATURES, 4), "wb": d(4), "v": d(4, 3), "u": d(4, 3), "a": d(3), "c": d(4), "cb": np.zeros(())}
    m = quality.Model(np.zeros(quality.N_FEATURES), np.ones(quality.N_FEATURES), p)
    v = m.forward(x, begin)
    assert np.allclose(np.add.reduceat(v["att"], begin[:-1]), 1)
    loss = lambda: -np.mean(np.log(np.where(y == 1, (s := m.forward(x, begin)["y"]), 1 - s)))
    for name, g in m.gradients(v, begin, y).items():
        at = tuple(r.integers(0, n) for n in p[name].shape)
        keep, e = p[name].copy(), 1e-6
        sides = []
        for step in (e, -e):
            p[name] = keep.copy()
            p[name][at] += step
            sides.append(loss())
        p[name] = keep
        assert math.isclose((sides[0] - sides[1]) / (2 * e), g[at] - quality.DECAY * keep[at], rel_tol=1e-4, abs_tol=1e-7), name


def test_one_row_of_each_group_stays(spark):
    a, b, c = "one two three four five six seven eight", "eight nine ten eleven twelve thirteen fourteen", "x " * 3
    rows = [(3, a, "s"), (7, a, "s"), (7, b, "s"), (7, b, "t"), (7, b, "t"), (9, b.upper(), "s"), (9, c, "s"), (9, c + "y", "s"), (None, a, "s"), (None, a, "s"), (5, None, "s"), (5, None, "s"), (5, " \n", "s"), (1, "lone words of its own here", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("row", F.lit(1)).withColumn("t1", F.lit("x"))
    left = sorted(((r["doc_id"], r["text"]) for r in neardup.kept(docs, 5, 80).collect()), key=str)
    want = [(3, a), (7, b), (9, c), (9, c + "y"), (None, a), (None, a), (5, None), (5, None), (5, " \n"), (1, "lone words of its own here")]
    assert left == sorted(want, key=str)
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.groups(docs, 5, 80).collect())
    assert got[7, 3, False] == 1 and got[7, 7, True] == 3 and got[9, 7, False] == 1 and got[None, None, True] == 2


def test_near_groups_among_frequent_passages_equal_brute_force(spark, monkeypatch):
    """Edited copies, a passage that all share, and buckets larger than what a join or a tile takes."""
    monkeypatch.setattr(neardup, "SMALL", 3)
    monkeypatch.setattr(neardup, "TILE", 10)
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(5))
    shared = [word() for _ in range(60)]
    heads = [[word() for _ in range(r.randint(8, 90))] for _ in range(12)]
    texts = []
    for k in range(170):
        ws = list(heads[k % 12])
        for _ in range(r.choice([0, 1, 2, 4])):
            ws[r.randrange(len(ws))] = word()
        texts.append(" ".join(ws + shared * (k % 3 == 0)))
    sets = [{tuple(ws[k : k + 4]) for k in range(max(1, len(ws) - 3))} for ws in map(str.split, texts)]
    links = [(a, b) for a in range(170) for b in range(a + 1, 170) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = smallest_reachable(range(170), links)
    got = by_id(neardup.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4, 80))
    assert {k: g["component_id"] for k, g in got.items()} == want and len(links) > 200


def test_line_runs_of_many_lengths_equal_all_windows(spark):
    """Short and blank lines make windows of many lines, so several levels of doubling."""
    r = random.Random(13)
    pool = ["", "a", "b c", "d", "e f g"]
    block = [r.choice(pool) for _ in range(60)]
    docs = {i: [r.choice(pool) for _ in range(r.randint(0, 5))] + block[(s := r.randint(0, 20)) : s + r.randint(10, 40)] + [r.choice(pool) for _ in range(r.randint(0, 30))] for i in range(10)}
    first, want = set(), {i: set() for i in docs}
    for i in sorted(docs):
        for a in range(len(docs[i])):
            for b in range(a + 1, len(docs[i]) + 1):
                if sum(len(x.split()) for x in docs[i][a:b]) >= linededup.MIN_WORDS:
                    run = tuple(docs[i][a:b])
                    if run in first:
                        want[i] |= set(range(a, b))
                    first.add(run)
    rows = [(i, "\n".join(x)) for i, x in docs.items()]
    got = by_id(linededup.digest(spark.createDataFrame([*rows, rows[3]], "doc_id long, text string")))
    spans = lambda s: {k for part in s.split(",") if part for k in range(*map(int, part.split(":")))}
    assert {i: spans(x["removed"]) for i, x in got.items()} == want and any(want.values())


CLASHING = ("row", "key", "class", "score", "size", "lang", "block", "kept", "rank", "t1", "c1", "doc", "id", "component", "words", "label_", "n", "cid")
ODD = [(1, None, "s"), (2, "", "s"), (None, "a text without an id", None), (3, "same row", "s"), (3, "same row", "s"), (4, "word " * 30_000, None), (6, "é" * 300 + "@x.y", "t")]


def odd(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit("x"))
    return docs


def test_clashing_columns_and_values(spark):
    docs = odd(spark)
    key = lambda rows: Counter((r["doc_id"], r["text"]) for r in rows)
    every = Counter((i, t) for i, t, _ in ODD)
    once = Counter(set(every))
    bench = spark.createDataFrame([(1, "same row"), (2, None)], "item_id long, text string")
    hits = decontaminate.contaminated(docs, bench).collect()
    assert [(h["doc_id"], h["item_id"], h["similarity"], h["first_word"], h["end_word"]) for h in hits] == [(3, 1, 1.0, 0, 2)] * 2
    for table, want in ((decontaminate.clean(docs, bench), every - Counter({(3, "same row"): 2})), (neardup.kept(docs, 5, 80), once), (linededup.dedup(docs), every)):
        assert table.columns == docs.columns and key(table.collect()) == want
    labels = spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, quality int")
    assert quality.accepted(docs, labels.where("quality = 1")).columns == docs.columns
    assert {(r["doc_id"], r["predicted"]) for r in quality.classify(docs, labels.where("quality = 1")).collect()} == {(i, 1) for i, _, _ in ODD}
    assert {(r["doc_id"], r["size"]) for r in mixing.mix(docs).collect()} == {(i, len(WORD.findall(t or ""))) for i, t, _ in ODD}
    clean = pii.sanitise(docs).collect()
    assert key(clean) == every
    sha = hashlib.sha256(b"").hexdigest()
    assert all(r["base_sha256"] == sha and r["spans"] == "" for r in pii.digest(docs).collect())
    assert {(r["doc_id"], r["n_lines"], r["removed"]) for r in linededup.digest(docs).collect()} == {(i, 0 if t is None else 1, "") for i, t, _ in ODD}
    assert {(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["labels"], r["score"]) for r in licenses.digest(docs).collect()} == {(i, len(licenses._split(t or "")), 0, None, "", 0.0) for i, t, _ in ODD}
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://b.org/fr/"), (3, None)], "page_id long, url string")
    for c in CLASHING:
        vectors, pages = vectors.withColumn(c, F.lit("x")), pages.withColumn(c, F.lit("x"))
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.groups(vectors, 0.93).collect()} == {(1, 1, 1), (2, 1, 1)}
    got = by_id(urls.judge(pages), "page_id")
    assert [(got[k]["host"], got[k]["path"], got[k]["rule"]) for k in (1, 2, 3)] == [("a.net", "/x", "net/"), ("b.org", "/fr/", "org/fr/"), ("", "", None)]


def test_samples_and_bit_tables(spark):
    rows = spark.range(20_000)
    assert 700 < rows.where(sampled("id", 0.05)).count() < 1300 and rows.where(sampled("id", 1.0)).count() == 20_000 and rows.where(sampled("id", 3.0)).count() == 20_000
    # a share far below a millionth still has a cut of its own
    assert rows.select(sampled("id", 1e-12).alias("x")).where("x").count() == 0
    table = bit_table(spark.createDataFrame([(0,), (70_000,), ((1 << 17) - 1,)], "bit long"), 17)
    assert may_hold(table, np.array([0, 1, 70_000, 70_001, (1 << 17) - 1])).tolist() == [True, False, True, False, True]
    assert bit_table(spark.range(0).withColumnRenamed("id", "bit"), 17) is None and not may_hold(None, np.array([3])).any()


def test_long_texts_and_words(monkeypatch):
    """Hashes taken in steps are those taken at once, and a very long word costs little more than its length."""
    from evidara.llm import textarrays as t

    r = np.random.default_rng(3)
    data = r.choice(np.frombuffer(b"ab cd\n", np.uint8), 5000)
    starts, ends, _ = t.words(data, np.array([0, len(data)]), t.NOT_SPACE)
    whole = t.Hasher().of(data, starts, ends)
    monkeypatch.setattr(t, "STEP", 37)
    assert (t.Hasher().of(data, starts, ends) == whole).all()
    monkeypatch.setattr(t, "STEP", 4 << 20)
    model, pieces = lattice.Lattice([b" ", b"a", b"b", b"ab", b" a"]), 5
    weight = np.log10(np.full(pieces, 0.2))
    word = b"ab" * 20_000
    got, expected = model.run(np.frombuffer(word + b"b", np.uint8), np.array([0, len(word), len(word) + 1]), weight, np.array([1, 1]))
    log = [0.0, math.log10(0.2)]  # places after the mark, in the word: each pair is two pieces or one
    ways = math.log10(0.04 + 0.2)
    first = math.log10(0.2 * (0.04 + 0.2) + 0.2 * 0.2)
    assert math.isclose(got[0], first + 19_999 * ways, rel_tol=1e-9) and math.isclose(got[1], 2 * log[1]) and expected[3] > 9_000

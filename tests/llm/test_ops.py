"""The ten training-data operators against plain Python over whole small tables, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidara.llm import decontaminate, embeddings, lattice, licenses, linededup, mixing, neardup, pii, quality, queries, urls
from evidara.llm.graph import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def smallest_reachable(nodes, links):
    head = {n: n for n in nodes}

    def top(x):
        while head[x] != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    for a, b in links:
        head[max(top(a), top(b))] = min(top(a), top(b))
    return {n: top(n) for n in nodes}


def plain_entities(text):
    def luhn(d):
        s = [int(c) for c in d[::-1]]
        return (sum(s[::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]}
    found["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return found


def test_pii_equals_plain_patterns(spark, sf_dir, texts):
    r = random.Random(3)
    for _ in range(4000):
        t = "".join(r.choice("a@.1 +-(2)..0@b") for _ in range(r.randint(0, 40)))
        assert pii.entities(t) == plain_entities(t), t
    got = by_id(queries.op1_pii_sanitise(spark, sf_dir))
    for i, t in texts.items():
        want = plain_entities(t)
        joined = ",".join(f"{k}:{s}:{e}" for k in pii.KINDS for s, e in want[k])
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [len(want[k]) for k in pii.KINDS]
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert got[i]["spans"].startswith(joined)


def test_pii_terms_that_disclose_go(spark):
    rows = [(i, f"ask Quillon at bob@corp.example.com about it {i}") for i in range(5)] + [(10 + i, f"nothing about this at all {i}") for i in range(40)]
    got = by_id(pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")))
    assert "Quillon" not in got[0]["text"] and "bob@" not in got[0]["text"] and "about" in got[0]["text"]
    assert got[12]["text"] == rows[7][1]


def test_pii_terms_that_disclose_go_wherever_they_stand(spark):
    long, far = "z" * 300, "word " * 30
    rows = [(i, f"ask {long} Quillon at bob@corp.example.com about it {i} {far}then QUILLON came") for i in range(5)]
    rows += [(10, "QUILLON alone, Quillons not"), (11, "Quillon@other.example.org"), (12, None)] + [(20 + i, f"nothing about this at all {i} {far}then came") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(pii.sanitise(docs))
    assert all("quillon" not in got[i]["text"].lower() and long[:9] not in got[i]["text"] and "then" in got[i]["text"] for i in range(5))
    assert got[10]["text"] == "[TERM] alone, Quillons not" and got[11]["text"] == "[EMAIL]" and got[12]["text"] is None
    assert all(got[i]["text"] == t for i, t in rows[8:])
    at = {i: [m.span() for m in re.finditer(r"(?i)\bquillon\b(?!@)", t or "")] for i, t in rows}
    assert all({f"term:{s}:{e}" for s, e in at[r["doc_id"]]} <= set(r["spans"].split(",")) for r in pii.digest(docs).collect())


def test_embedding_links_equal_brute_force(spark, sf_dir):
    """The whole table, and noisy copies of some of its vectors on both sides of the threshold."""
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()]
    r = np.random.default_rng(2)
    for k in range(120):
        base = np.array(rows[k % 25][1])
        noise = r.normal(size=len(base))
        noise *= r.uniform(0, 0.8) * np.linalg.norm(base) / np.linalg.norm(noise)
        rows.append((10_000 + k, ((base + noise) * r.uniform(0.1, 5)).astype(np.float32).tolist(), rows[k % 25][2]))
    x = np.array([v for _, v, _ in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([n for _, _, n in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    ids = [i for i, _, _ in rows]
    want = smallest_reachable(ids, [(ids[a], ids[b]) for a, b in np.argwhere(near) if a < b])
    for i, n in zip(ids, near.sum(1), strict=True):
        want[i] = (int(n), want[i], want[i] == i)
    got = by_id(embeddings.groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), cosine=0.93), "vec_id")
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == want
    assert near.any()


def test_embedding_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [float("nan"), 1.0], 1), (8, [1.0, None], 1), (9, [1.0], 1), (10, [1.0, 0.01], 1)]
    got = by_id(embeddings.groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.93), "vec_id")
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == {1: (2, 1), 2: (2, 1), 10: (2, 1)} | {i: (0, i) for i in (3, 4, 5, 6, 7, 8, 9)}


def test_url_rules_equal_plain_python(spark, sf_dir):
    rows = [(-1, None), (-2, "no scheme"), (-3, "http://A.NET"), (-4, "http://example.org/fr/x?y#z"), (-5, "x://org#/fr/"), (-6, "http://xnet/"), (-7, "http://sub.EXAMPLE.net/en/1")]
    pages = spark.createDataFrame(rows, "page_id long, url string").union(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    got = by_id(urls.judge(pages), "page_id")
    for r in pages.collect():
        rest = (r["url"] or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
        fits = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, None))
        mine = got[r["page_id"]]
        assert (mine["host"], mine["path"], mine["rule"]) == (host, path, rule)
        assert mine["verdict"] == verdict or verdict is None and mine["verdict"] in ("allow", "block")


def test_lattice_sums_all_segmentations():
    pieces = [b" ", b" a", b"a", b"b", b"ab", b"ba", b"aab", b" ab"]
    weight = np.log10(np.arange(1, 9) / 40)
    words = [b"aab", b"b", b"abab"]
    model = lattice.Lattice(pieces)
    got, _ = model.run(np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)]), weight)

    def total(rest):
        return 1.0 if not rest else sum(10 ** weight[k] * total(rest[len(p) :]) for k, p in enumerate(pieces) if rest.startswith(p))

    assert np.allclose(got, [math.log10(total(b" " + w)) for w in words])


def test_lm_counts_equal_plain_python(spark, sf_dir, texts):
    got = by_id(queries.op4_lattice_lm(spark, sf_dir))
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    tokens = {i: [*WORD.findall(t.translate(LOWER)), None] for i, t in texts.items()}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert -math.inf < r["score"] < 0


def test_mix_meets_targets(spark, sf_dir, texts):
    rows = by_id(queries.op5_source_mixing(spark, sf_dir))
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source").collect()}
    size = {i: len(WORD.findall(t)) for i, t in texts.items()}
    of = Counter()
    for i, n in size.items():
        of[source[i]] += n
    order = sorted(of, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    capped = set()
    while True:
        level = (sum(of.values()) - 3 * sum(of[s] for s in capped)) / max(1, sum(weight[s] for s in order if s not in capped))
        more = {s for s in order if s not in capped and weight[s] * level > 3 * of[s]}
        if not more:
            break
        capped |= more
    taken = Counter()
    for i, r in rows.items():
        assert r["size"] == size[i] and r["source_size"] == of[source[i]] and 0 <= r["taken"] <= 3 * size[i]
        assert math.isclose(r["target"], 3 * of[source[i]] if source[i] in capped else weight[source[i]] * level, rel_tol=1e-9)
        taken[source[i]] += r["taken"]
    for i, r in rows.items():
        assert abs(taken[source[i]] - r["target"]) <= max(n for j, n in size.items() if source[j] == source[i])
    again = by_id(queries.op5_source_mixing(spark, sf_dir))
    assert {i: r["taken"] for i, r in rows.items()} == {i: r["taken"] for i, r in again.items()}


def test_line_dedup_equals_all_windows(spark):
    r = random.Random(5)
    pool = [" ".join(r.choice("abcdefgh") * 3 for _ in range(r.choice([0, 1, 4, 7, 12]))) for _ in range(9)]
    docs = {i: [r.choice(pool) for _ in range(r.randint(0, 14))] for i in range(14)}
    words = lambda line: len(line.split(" ")) if line else 0
    first, want = {}, {i: set() for i in docs}
    for i in sorted(docs):
        for a in range(len(docs[i])):
            for b in range(a + 1, len(docs[i]) + 1):
                if sum(map(words, docs[i][a:b])) >= linededup.MIN_WORDS:
                    if tuple(docs[i][a:b]) in first:
                        want[i] |= set(range(a, b))
                    else:
                        first[tuple(docs[i][a:b])] = i
    rows = [(i, "\n".join(x)) for i, x in docs.items()]
    got = by_id(linededup.digest(spark.createDataFrame(rows, "doc_id long, text string")))
    spans = lambda s: {k for part in s.split(",") if part for k in range(*map(int, part.split(":")))}
    assert {i: spans(x["removed"]) for i, x in got.items()} == want
    assert any(want.values())
    kept = by_id(linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    for i, lines in docs.items():
        left = [x for k, x in enumerate(lines) if k not in want[i]]
        assert (i in kept) == bool(left or not lines) and (i not in kept or kept[i]["text"] == "\n".join(left))


def test_line_dedup_counts_words_between_any_white_space(spark):
    table = "\n".join("\t".join(f"r{k}c{c}" for c in range(12)) for k in range(5))
    wide = "\n".join(f"few   wide    words  {k}" for k in range(4))  # 16 words, 40 spaces
    blank = "\n".join([" " * 30, "\t \r"] * 3)
    rows = [(2 * k + i, t) for k, t in enumerate([table, wide, blank]) for i in range(2)]
    got = by_id(linededup.digest(spark.createDataFrame([(i, f"head {i}\n{t}") for i, t in rows], "doc_id long, text string")))
    assert {i: r["removed"] for i, r in got.items()} == {0: "", 1: "1:6", 2: "", 3: "", 4: "", 5: ""}


def test_license_places_equal_plain_python(spark, sf_dir, texts):
    extra = {-1: "CC BY cc by", -2: "all rights reserved! General  Public-License", -3: "", -4: "by cc"}
    docs = spark.createDataFrame([*extra.items()], "doc_id long, text string").union(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    got = by_id(licenses.digest(docs))
    for i, t in (texts | extra).items():
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
        places = [(k, label) for p, label in licenses.BASE.items() for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split()]
        at, labels = [k for k, _ in places], sorted({x for _, x in places})
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(labels))
        assert set(labels) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_decontamination_finds_planted_and_spares_clean(spark, sf_dir, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    r = random.Random(1)
    noise = lambda n: " ".join("".join(r.choice("qxzvk") for _ in range(6)) for _ in range(n))
    rows, want = [], {}
    for k, (i, t) in enumerate(items.items()):
        ws = t.split()
        if k % 2:
            ws[len(ws) // 2] = "changed"
        rows.append((k, f"{noise(k % 37)} {' '.join(ws)} {noise(29)}"))
        if len(ws) >= 60 or not k % 2:
            want[k] = i
    rows += [(1000 + k, noise(200)) for k in range(20)]
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()
    pairs = {(g["doc_id"], g["item_id"]) for g in got}
    assert set(want.items()) <= pairs and all(d < 1000 and g >= 0.8 for d, g in ((g["doc_id"], g["similarity"]) for g in got))
    whole = {(g["doc_id"], g["item_id"]) for g in queries.op8_decontaminate(spark, sf_dir).collect()}
    assert {(d, i) for d, t in texts.items() for i, b in items.items() if b in t} <= whole


def test_decontamination_finds_block_edits_near_the_threshold(spark):
    """Every passage with one edited block whose weighted Jaccard similarity, by brute force, reaches 0.8."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    items = [[word() for _ in range(n)] for n in (30, 60, 80, 120, 200, 300)]
    grams = lambda ws: Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4))
    holders = Counter(g for ws in items for g in grams(ws))
    weight = lambda c: sum(math.log(1 + len(items) / holders.get(g, 1)) * n for g, n in c.items())
    rows, want = [], {}
    for i, ws in enumerate(items):
        near = (len(ws) - 4) // 9 - 4
        for _ in range(40):
            size, kind = max(1, near - r.randint(0, 2)), r.choice(["replace", "delete"])
            at = r.choice([(len(ws) - size) // 2, r.randint(0, len(ws) - size)])
            lead = [word() for _ in range(r.randint(0, 40))]
            doc = lead + ws[:at] + [word() for _ in range(size * (kind == "replace"))] + ws[at + size :] + [word() for _ in range(60)]
            mine, theirs = grams(ws), grams(doc[len(lead) : len(lead) + len(ws)])
            if weight(mine & theirs) >= 0.8 * weight(mine | theirs):
                want[len(rows)] = i
            rows.append((len(rows), " ".join(doc)))
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(items)], "item_id long, text string")
    found = {(g["doc_id"], g["item_id"]) for g in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert len(want) > 100 and set(want.items()) - found == set()


def test_quality_on_held_out_labels(spark):
    big = "/root/testdata/sf0.01"
    rows = queries.op9_quality_classifier(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out").collect()
    pos, neg = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    assert sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) > 0.9
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_quality_never_learns_from_held_out_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (by_id(quality.classify(docs, x)) for x in (labels, turned))
    assert {i: r["score"] for i, r in a.items()} == {i: r["score"] for i, r in b.items()}


def shingle_set(text, size):
    ws = WORD.findall(text.translate(LOWER))
    return {tuple(ws[k : k + size]) for k in range(max(1, len(ws) - size + 1))} if ws else set()


def test_near_duplicates_equal_brute_force(spark, sf_dir, texts):
    sets = {i: shingle_set(t, 4) for i, t in texts.items()}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = smallest_reachable(ids, links)
    got = by_id(queries.op10_minhash_neardup(spark, sf_dir))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in ids}
    assert links


def test_chain_and_star_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)}


ODD = [(1, None, "s"), (2, "", "s"), (None, "a text without an id", None), (3, "same row", "s"), (3, "same row", "s"), (4, "word " * 30_000, None), (5, "one\n\ntwo  +1 (2) 3", "t"), (6, "é" * 300 + "@x.y", "t")]
APPLY = {
    "pii": lambda d, s: pii.digest(d),
    "lm": lambda d, s: lattice.score(d),
    "mixing": lambda d, s: mixing.digest(d),
    "lines": lambda d, s: linededup.digest(d),
    "dedup": lambda d, s: linededup.dedup(d),
    "licenses": lambda d, s: licenses.digest(d),
    "quality": lambda d, s: quality.classify(d, s.createDataFrame([(3, 1), (5, 0), (3, None), (None, 1)], "doc_id long, quality int")),
    "near": lambda d, s: neardup.groups(d, 4, 80),
    "benchmark": lambda d, s: decontaminate.clean(d, s.createDataFrame([(1, None), (2, ""), (3, "nowhere to be found at all")], "item_id long, text string")),
}


@pytest.mark.parametrize("name", APPLY)
def test_odd_rows_keep_their_row(spark, name):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    for c in ("row", "key", "class", "score", "size", "lang", "block", "kept", "rank"):
        docs = docs.withColumn(c, F.lit("x"))
    assert APPLY[name](docs, spark).count() == len(ODD)
    assert APPLY[name](docs.limit(0), spark).count() == 0


def test_empty_tables(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert embeddings.groups(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), 0.93).count() == 0


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = p.reread(stage(spark, docs, sf_dir), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert 0 < docs.count() <= before
        before = docs.count()
    sets = {r["doc_id"]: shingle_set(r["text"], 5) for r in docs.collect()}
    assert not [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    mixed = p.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in mixed} <= set(sets) and all(r["taken"] == r["copies"] * r["size"] for r in mixed)

"""Features and scores recomputed in plain Python, the whole pipeline over odd tables, and very long texts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from evidara.llm import licenses, pii, quality, urls
from evidara.llm.textarrays import Hasher


def test_url_features_equal_plain_python(spark, sf_dir):
    rows = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    rows += [(-1, None), (-2, ""), (-3, "no scheme"), (-4, "http://A.B.Example.NET/x-y/1?p=1&q=&&r#f"), (-5, "http:///only/path"), (-6, "x://net"), (-7, "http://" + "a-1." * 500 + "org/fr/" + "z/" * 3000), (-8, "http://é.com/ü?ß"), (-4, "http://A.B.Example.NET/x-y/1?p=1&q=&&r#f")]
    located = urls.located(spark.createDataFrame(rows, "page_id long, url string"))
    got = urls.featured(located).collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = []
    for _, url in rows:
        u = url or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0].translate(lower)
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [(len(h + p), v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        label = {"block": 1, "allow": 0}.get(max(fits)[1]) if fits else None
        query = re.search(r"\?([^#]*)", u)
        suffix = ".".join(host.split(".")[-2:])
        n = len(u)
        plain.append({"label": label, "host": host, "suffix": suffix, "top": suffix.split(".")[-1].lower(), "length": n, "host_length": len(host), "path_length": len(path), "depth": path.count("/"), "host_dots": host.count("."), "hyphens": u.count("-"), "digit_ratio": len(re.findall("[0-9]", u)) / max(n, 1), "entropy": -sum(c / n * math.log2(c / n) for c in Counter(u).values()), "parameters": query[1].count("&") + 1 if query and query[1] else 0})
    total, labelled = len(plain), [p for p in plain if p["label"] is not None]
    rate = sum(p["label"] for p in labelled) / len(labelled)
    for key, name in (("suffix", "suffix"), ("top", "label")):
        count = Counter(p[key] for p in plain)
        for p in plain:
            own = [q for q in labelled if q[key] == p[key] and q["host"] != p["host"]]
            p[f"{name}_share"] = count[p[key]] / total
            p[f"{name}_block_rate"] = (sum(q["label"] for q in own) + 10 * rate) / (len(own) + 10)
    order = lambda r: tuple(round(float(r[f]), 9) for f in urls.FEATURES)
    assert Counter(map(order, got)) == Counter(map(order, plain))


def plain_passage(words, text):
    """The features of one passage, given its words as byte spans of the text."""
    ranges = [[(65, 90)], [(97, 122)], [(48, 57)], [(128, 255)], [(33, 33), (63, 63)], [(44, 44), (46, 46), (58, 59)], [(35, 38), (42, 43), (60, 62), (64, 64), (91, 96), (123, 126)], [(34, 34), (39, 41), (45, 45), (47, 47)]]
    inside = text[words[0][0] : words[-1][1]] if words else b""
    share = [sum(any(a <= c <= b for a, b in r) for c in inside) / max(1, len(inside)) for r in ranges]
    sizes = [b - a for a, b in words]
    n = max(1, len(words))
    mean = sum(sizes) / n
    return share, mean, math.sqrt(max(0, sum(s * s for s in sizes) / n - mean**2)), sum(s == 1 for s in sizes) / n, inside.count(10) / n, math.log1p(len(words))


def test_quality_passages_and_scores_equal_plain_python():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abC1é.!(#-") for _ in range(r.randint(1, 8)))
    texts = ["", " \n", "one", "same Same same"] + ["\n".join(" ".join(word() for _ in range(r.randint(1, 40))) for _ in range(r.randint(1, 20))) for _ in range(25)]
    data = "".join(texts).encode()
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    x, begin = quality.passages(np.frombuffer(data, np.uint8), off, Hasher())
    k = 0
    for i, t in enumerate(texts):
        raw = t.encode()
        words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        parts = [words[j : j + quality.PASSAGE] for j in range(0, len(words), quality.PASSAGE)] or [[]]
        assert begin[i + 1] - begin[i] == len(parts)
        for j, part in enumerate(parts):
            share, mean, spread, single, lines, size = plain_passage(part, raw)
            low = [raw[a:b].lower() for a, b in words]
            first = j * quality.PASSAGE
            again = sum(m > 0 and low[m] == low[m - 1] for m in range(first, first + len(part))) / max(1, len(part))
            assert np.allclose(x[k], [*share, again, mean, spread, single, lines, size], atol=1e-6)
            k += 1
    g = np.random.default_rng(1)
    h, a = quality.HIDDEN, quality.ATTENTION
    p = {"w": g.normal(size=(quality.N_FEATURES, h)), "wb": g.normal(size=h), "v": g.normal(size=(h, a)), "u": g.normal(size=(h, a)), "a": g.normal(size=a), "c": g.normal(size=h), "cb": np.array(0.3)}
    model = quality.Model(x.mean(0), x.std(0) + 1e-6, p)
    got = model.forward(x, begin)["y"]
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    for i in range(len(texts)):
        encoded, weights = [], []
        for row in x[begin[i] : begin[i + 1]]:
            z = [min(8, max(-8, (row[f] - model.mean[f]) / model.scale[f])) for f in range(len(row))]
            hid = [math.tanh(sum(z[f] * p["w"][f, m] for f in range(len(z))) + p["wb"][m]) for m in range(h)]
            gate = sum(p["a"][m] * math.tanh(sum(hid[q] * p["v"][q, m] for q in range(h))) * sigmoid(sum(hid[q] * p["u"][q, m] for q in range(h))) for m in range(a))
            encoded.append(hid)
            weights.append(math.exp(gate))
        mixed = [sum(w * e[m] for w, e in zip(weights, encoded, strict=True)) / sum(weights) for m in range(h)]
        assert abs(got[i] - sigmoid(sum(mixed[m] * p["c"][m] for m in range(h)) + 0.3)) < 1e-9


def tables(spark, folder, docs, labels, bench):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_over_odd_tables(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(2)
    prose = lambda n: " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(2, 8))) for _ in range(n))
    same, item = prose(80), prose(30)
    rows = [(i, prose(60 + i), "en", ["a", "b", None][i % 3]) for i in range(30)]
    rows += [(100, same, "en", "a"), (101, same, "en", "b"), (101, same, "en", "b"), (102, f"{prose(20)} {item} {prose(20)}", None, "a"), (None, prose(40), "en", "a"), (None, None, None, None), (103, None, "en", "a"), (104, "", "en", "b"), (105, prose(40_000), "en", "a"), (5, "an identifier twice", "en", "b")]
    extra = "row string, score double, size long, text_ string, word string, class string, t1 long, copies int, pos int, doc string, key string"
    docs = spark.createDataFrame([(*x, len(x[1] or ""), "r", 0.1, 1, "t", "w", "c", 2, 3, 4, "d", "k") for x in rows], f"{DOCS}, {extra}")
    folder = tables(spark, tmp_path, docs, [(0, 1, 0), (1, 1, 0), (None, 1, 0), (2, None, None), (3, 1, 1)], [(None, item), (None, item), (1, None)])
    kept, read = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, read, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        read = spark.read.parquet(f"{folder}/{name}")
        kept[name] = Counter(x["doc_id"] for x in read.collect())
    assert set(kept["quality_filter"]) == {x[0] for x in rows}  # labels of one class: all stay
    assert kept["near_dedup"][100] + kept["near_dedup"][101] == 1 and kept["near_dedup"][None] == 2
    assert 102 in kept["near_dedup"] and 102 not in kept["benchmark_decontamination"]
    mixed = {x["doc_id"]: x for x in corpus_pipeline.run(spark, folder).collect()}
    assert mixed and all(x["copies"] > 0 and x["taken"] <= 3 * x["size"] for x in mixed.values())
    assert set(mixed) <= set(kept["benchmark_decontamination"])


def test_pipeline_over_empty_tables(spark, tmp_path):
    import corpus_pipeline

    folder = tables(spark, tmp_path, spark.createDataFrame([], DOCS), [], [])
    assert corpus_pipeline.run(spark, folder).collect() == []


@pytest.mark.parametrize("name", ["pii", "licenses"])
def test_very_long_texts(spark, name):
    """Two million words, what is looked for at the far end, and one word of a million characters."""
    filler = "word " * 2_000_000
    rows = [(1, filler + "mail bob@corp.example.com all rights reserved"), (2, "x" * 1_000_000), (3, "bob@corp.example.com")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if name == "pii":
        got = {r["doc_id"]: r for r in pii.digest(docs).collect()}
        at = len(filler) + 5
        assert got[1]["n_email"] == 1 and got[1]["spans"].startswith(f"email:{at}:{at + 20}") and got[2]["n_email"] == 0 and got[3]["spans"].startswith("email:0:20")
    else:
        got = {r["doc_id"]: r for r in licenses.digest(docs).collect()}
        assert (got[1]["n_base"], got[1]["first_word"], got[1]["base_labels"]) == (1, 2_000_005, "reserved") and got[2]["n_words"] == 1

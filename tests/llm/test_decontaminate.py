"""Decontamination: identifiers that are null or repeat, parts of the benchmark in one pass, and the corpus's own items."""

import math
import random
from collections import Counter

import pytest

from evidara.llm import decontaminate

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 9))) for _ in range(n))


def test_null_and_repeated_item_ids(spark):
    r = random.Random(1)
    items = [(None, sentence(r, 30)), (7, sentence(r, 30)), (7, sentence(r, 30)), (None, None), (None, sentence(r, 30)), (8, sentence(r, 30)), (9, "")]
    items.append(items[5])  # a repeated row
    docs = [(k, f"{sentence(r, 40)} {t} {sentence(r, 40)}") for k, (_, t) in enumerate(items) if t] + [(None, items[0][1]), (50, sentence(r, 90)), (51, None)]
    docs, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    want = Counter({(0, None): 1, (1, 7): 1, (2, 7): 1, (4, None): 1, (5, 8): 2, (7, 8): 2, (None, None): 1})
    assert Counter((x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(docs, bench).collect()) == want
    assert {x["doc_id"] for x in decontaminate.clean(docs, bench).collect()} == {50, 51}


def test_five_parts_are_one_pass(spark, monkeypatch, tmp_path):
    r = random.Random(2)
    items = [(k, sentence(r, 40)) for k in range(30)]
    docs = [(k, f"{sentence(r, 20)} {items[k][1]} {sentence(r, 9)}") for k in range(0, 30, 2)] + [(100 + k, sentence(r, 60)) for k in range(20)]
    docs, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    one = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "PART", -(-sum(len(t) + 16 for _, t in items) // 5))
    assert len(decontaminate.Parts(bench).indexes) == 5
    for df in (decontaminate.contaminated(docs, bench), decontaminate.clean(docs, bench)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == plan.count("MapInArrow") == 1
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench).collect())) == one and len(one) >= 15
    assert sorted(x["doc_id"] for x in decontaminate.clean(docs, bench).collect()) == list(range(100, 120))


@pytest.mark.parametrize("edit", ["change", "put in", "leave out"])
def test_edited_copies_of_the_corpus_own_items(spark, sf_dir, edit):
    """Items of the table, short ones of 15 to 25 words included, set into its documents with one word edited; those whose weighted similarity is at least 0.8."""
    r = random.Random(edit)
    items = [(x["item_id"], x["text"].split()) for x in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if x["text"]]
    hosts = [x["text"].split()[:60] for x in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80).collect() if x["text"]]
    shingles = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    holders = Counter(s for _, w in items for s in shingles([x.lower() for x in w]))
    weight = lambda s: math.log(1 + len(items) / holders[s]) if s in holders else math.log(1 + len(items))
    weighed = lambda c: sum(weight(s) * n for s, n in c.items())
    rows, want = [], set()
    for _ in range(4):
        for item_id, words in items:
            at, new = r.randrange(len(words)), sentence(r, 1)
            copy = words[:at] + {"change": [new], "put in": [new, words[at]], "leave out": []}[edit] + words[at + 1 :]
            a, b = shingles([w.lower() for w in words]), shingles([w.lower() for w in copy])
            other = math.log(1 + len(items)) * sum(n for s, n in b.items() if s not in a) + weighed(Counter({s: n - a[s] for s, n in b.items() if s in a and n > a[s]}))
            if weighed(a & b) >= 0.8 * (weighed(a) + other):
                want.add((len(rows), item_id))
                host = r.choice(hosts)
                cut = r.randrange(len(host))
                rows.append((len(rows), " ".join([*host[:cut], *copy, *host[cut:]])))
    found = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, " ".join(w)) for i, w in items], ITEMS)).collect()}
    assert len(want) > 30 and len(found & want) >= 0.9 * len(want), (len(found & want), len(want))

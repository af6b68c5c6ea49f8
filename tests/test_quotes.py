"""Quotes anywhere in documents against plain search."""

import random
from collections import Counter

from evidara.operators import evidence


def test_quotes_equal_plain_search(spark):
    r = random.Random(4)
    text = lambda n: "".join(r.choice("ab😀é.AB  \n\t") for _ in range(n))
    docs = [(k, text(r.randint(0, 60))) for k in range(60)] + [(None, "no id ab"), (5, None), (6, ""), (7, "ab ab ab ab ab"), (7, "ab ab ab ab ab"), (8, "one two three four"), (9, " \n"), (10, "\r")]
    quotes = [(k, text(r.randint(1, 5))) for k in range(150)] + [(200 + k, (t or "")[i : i + r.randint(4, 20)]) for k in range(100) for _, t in [r.choice(docs)] for i in [r.randint(0, 20)]]
    quotes += [(None, "ab"), (500, None), (501, ""), (502, "ab ab"), (502, "ab ab"), (503, "e two thr"), (504, "two"), (505, "two three four five"), (506, "\n"), (507, "  "), (508, "w"), (509, "one missing four")]
    want = Counter((i, j, t.find(q) + 1) for i, q in quotes for j, t in docs if q and t and q in t)
    got = evidence.locate_quotes(spark.createDataFrame(quotes, "quote_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == want and len(want) > 500
    assert evidence.locate_quotes(spark.createDataFrame([], "quote_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")).collect() == []
    assert evidence.locate_quotes(spark.createDataFrame(quotes, "quote_id long, text string"), spark.createDataFrame([], "doc_id long, text string")).collect() == []

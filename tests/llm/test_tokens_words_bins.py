"""Alignment, spelling variants and packing against plain Python over a whole small table, and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from evidara.llm import alignment, packing, queries, spelling, tokens

A, B, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "  two  blanks \n\n lines\t", "a ▁ b", "<|endoftext|> and </s> <0x41> <unk>", "x" * 3000, "é è ÿ À × ÷ ß", "中文 한글 😀🏽 ﬁ ​́ é", "İSTANBUL Σς it's 'LL", "\x00\x01 \x1c\x1d\x85\xa0 end "]
SCHEMA = "doc_id long, text string, word string, n long, length long, row long, block long, class string"


def odd_table(spark, texts):
    """The texts with clashing columns, a null doc_id, a repeated row and rows that share a doc_id."""
    rows = [(i, t, "w", 1, 2, 3, 4, "c") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "no identifier here", *rows[0][2:]), rows[4], (4, "another text of it", *rows[0][2:])], SCHEMA)


def bag(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# alignment


@pytest.fixture(scope="module")
def plain_alignment():
    whole = tokenizers.Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    names = {i: t for t, i in whole.get_vocab().items()}
    alphabet = tokens.byte_alphabet()
    byte = re.compile("<0x([0-9A-F]{2})>")

    def bytes_of(text):
        a, b = whole.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
        of_b = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) and pieces.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [pieces.id_to_piece(i)]]
        return a, [bytes(alphabet[c] for c in names[i]) for i in a], b, of_b

    def run(rows):
        docs = []
        for i, text in rows:
            doc = {"doc_id": i, "a": [], "b": [], "links": [], "groups": []}
            docs.append(doc)
            if not text:
                continue
            a, ab, b, bb = bytes_of(text)
            if b"".join(ab) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
                continue
            ends_a, ends_b = list(itertools.accumulate(map(len, ab))), list(itertools.accumulate(map(len, bb)))
            doc |= {"a": a, "b": b}
            j = 0
            for k, end in enumerate(ends_a):
                while j < len(b) and ends_b[j] - len(bb[j]) < end:
                    doc["links"].append((a[k], b[j]))
                    j += 1
                j -= ends_b[j - 1] > end
            x = y = 0
            for end in sorted(set(ends_a) & set(ends_b)):
                p, q = ends_a.index(end, x) + 1, ends_b.index(end, y) + 1
                doc["groups"].append((a[x:p], b[y:q]))
                x, y = p, q
        count = Counter(p for d in docs for p in set(d["links"]))
        top = defaultdict(int)
        for (a, _), n in count.items():
            top[a] = max(top[a], n)
        out = Counter()
        for d in docs:
            text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in d["groups"])
            out[d["doc_id"], len(d["a"]), len(d["b"]), len(d["groups"]), len(d["links"]), sum(count[p] == top[p[0]] for p in d["links"]), sum(count[p] for p in d["links"]), hashlib.sha256(text.encode()).hexdigest() if d["a"] else ""] += 1
        return out, docs

    return run


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_equals_plain_python(spark, sf_dir, plain_alignment):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert bag(queries.op11_cross_tokenizer_alignment(spark, sf_dir), *ALIGNED) == plain_alignment(rows)[0]


def test_alignment_odd_rows_in_small_steps(spark, plain_alignment, monkeypatch):
    """Blocks, slices and lists of events so small that documents reach across them."""
    monkeypatch.setattr(tokens, "SLICE", 40)
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    monkeypatch.setattr(alignment, "SWEPT", 30)
    monkeypatch.setattr(alignment, "BLOCK", 600)
    r = random.Random(4)
    words = ["the", "Aligned", "tokens,", "of", "ünïted", "x1y2", "wordly-wise", "(both)"]
    texts = ODD + [" ".join(r.choice(words) for _ in range(n)) for n in (1, 3, 80, 200, 5, 400)] + ["plain words first " * 20 + "▁ " + "and more behind " * 20]
    docs = odd_table(spark, texts)
    want, plain = plain_alignment([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert bag(alignment.align(docs, A, B, public_tokenizers.PATTERN), *ALIGNED) == want
    got = bag(alignment.links(docs, A, B, public_tokenizers.PATTERN), "doc_id", "group", "a", "b")
    within = {(d["doc_id"], k, x, y) for d in plain for k, (a, b) in enumerate(d["groups"]) for x, y in itertools.product(a, b)}
    without_group = Counter()
    for (i, _, a, b), n in got.items():
        without_group[i, a, b] += n
    assert without_group == Counter((d["doc_id"], *pair) for d in plain for pair in d["links"])
    assert set(got) <= within


def test_alignment_reads_one_exchange_twice(spark, sf_dir):
    """The runs are tokenised and shuffled once for both sweeps."""
    df = queries.op11_cross_tokenizer_alignment(spark, sf_dir)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_alignment_of_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty, A, B, public_tokenizers.PATTERN).collect() == []
    assert alignment.links(empty, A, B, public_tokenizers.PATTERN).collect() == []


# tokens


def test_parts_encode_as_whole_texts():
    r = random.Random(8)
    letters = list(" \t\n\r\x0b\x0c\x00\x01\x1c\x1f\x85\xa0aAsSdDLltT éÉ'’.,;:-_0123ßİΣςσǅﬁ中文한é​　▁<|>😀") + ["<|endoftext|>", "'s", "'LL", " the", " a", "  ", "ing"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(3000)]
    plain = tokenizers.Tokenizer.from_file(WORDS)
    words = tokens.WordVocabulary(WORDS)
    for t in texts:
        assert [i for s in words.encode(t.encode()) for i in s.tolist()] == plain.encode(t, add_special_tokens=False).ids, t
    whole = tokenizers.Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    both = tokens.TwoVocabularies(A, B, public_tokenizers.PATTERN)
    same = 0
    for t in filter(None, texts):
        got = [ids for _, ids in both.encode(t.encode())]
        a, b = whole.encode(" " + t, add_special_tokens=False).ids, pieces.encode(t)
        whole_text = (" " + t).encode()
        if b"".join(both.a_bytes[i] for i in a) == whole_text == b"".join(both.b_bytes[i] for i in b):
            assert [np.frombuffer(b"".join(x), np.uint16).tolist() for x in zip(*got, strict=True)] == [a, b], t
            same += 1
        else:
            assert None in got
    assert same > 500


# spelling variants


def plain_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 7
    return {w: n for w, n in counts.items() if n >= 2}


def plain_near(words):
    """Words one edit apart: those with a common word without one character, of equal length, or one longer."""
    short = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            short[w[:k] + w[k + 1 :], k].add(w)
    near = defaultdict(set)
    for (less, _), ws in short.items():
        for a, b in itertools.combinations(ws, 2):
            near[a].add(b)
            near[b].add(a)
        if less in words:
            for w in ws:
                near[w].add(less)
                near[less].add(w)
    return near


def plain_variants(words):
    near = plain_near(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v.encode()), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
    out = Counter()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None] += 1
    return out


VARIANT = ["word", "form", "root", "n", "n_near", "form_n"]


def test_spelling_equals_plain_python(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = plain_variants(plain_words(rows))
    assert bag(queries.op12_spelling_variants(spark, sf_dir), *VARIANT) == want
    assert any(k[4] for k in want)


@pytest.mark.parametrize("shard", [spelling.SHARD, 3])
def test_spelling_of_dense_words(spark, shard, monkeypatch):
    """All near words over two letters, with runs of equal ones, below prefixes that fit a task and that do not."""
    monkeypatch.setattr(spelling, "SHARD", shard)
    r = random.Random(shard)
    words = {"".join(r.choice("aé") for _ in range(r.randint(7, 10))): r.randint(2, 900) for _ in range(250)}
    words |= {w[:k] + c + w[k:]: r.randint(2, 90) for w in list(words)[:60] for k in (0, 2, 5, len(w)) for c in "ab"}
    got = spelling.near_pairs(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    near = plain_near(words)
    assert Counter(frozenset((p["a"], p["b"])) for p in got) == Counter({frozenset((a, b)): 1 for a in near for b in near[a]})
    assert all((words[p["a"]], words[p["b"]]) == (p["n_a"], p["n_b"]) for p in got)


def test_spelling_odd_rows_and_chains(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 30)
    texts = [None, "", "short word", "variants " * 3000 + "varients " * 250 + "varient " * 20 + "barient barient", "ÀÿÀÿÀÿÀ ÀÿÀÿÀÿÀ àÿÀÿÀÿÀ x÷×ÀÀÀÀÀ x÷×ÀÀÀÀÀ", "EQUALLY equally FORMING formong forming " * 40 + "formeng formeng", "a" * 5000 + " " + "a" * 5000, "naïveté's naïveté—naïvete naïvete日本"]
    docs = odd_table(spark, texts)
    want = plain_variants(plain_words([(r["doc_id"], r["text"]) for r in docs.collect()]))
    got = bag(spelling.variants(docs), *VARIANT)
    assert got == want
    root = {k[0]: k[2] for k in got}
    assert root["barient"] == root["varient"] == "variants"
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_spelling_deletes_nothing_without_a_doc_id():
    letters = (f"spelling{a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh")
    words = [w for w in letters if any(zlib.crc32(f"{prefix}:{w}".encode()) % 31 == 0 for prefix in ("", "None", 5))]
    text = " ".join(words).encode()
    assert dict(spelling.document_words(None, text)) == dict.fromkeys(words, 1)
    assert dict(spelling.document_words(5, text)) == dict(plain_words([(5, text.decode())] * 2)) | {w: 1 for w, n in spelling.document_words(5, text)}


# packing


def check_packing(rows, texts, capacity=4096):
    """rows of the result against the documents' own ids; returns the number of sequences."""
    plain = tokenizers.Tokenizer.from_file(WORDS)
    want, by_sequence = Counter(), defaultdict(list)
    for i, text in texts:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        for k, lo in enumerate(range(0, len(ids), capacity)):
            some = ids[lo : lo + capacity]
            want[i, k, lo, len(some), zlib.crc32(np.array(some, "<u4").tobytes())] += 1
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_of_the_table(spark, sf_dir):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = queries.op13_best_fit_packing(spark, sf_dir).collect()
    assert check_packing(rows, texts) <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_packing_odd_rows_in_many_groups(spark, monkeypatch):
    """Groups of a few pieces, dealt anew several times, and slices in the middle of documents."""
    monkeypatch.setattr(packing, "GROUP", 12)
    monkeypatch.setattr(tokens, "SLICE", 50)
    r = random.Random(2)
    texts = ODD + [" ".join(r.choice("ab of more Words it's 7 x-y".split()) for _ in range(r.randint(0, 90))) for _ in range(150)]
    docs = odd_table(spark, texts)
    rows = packing.pack(docs, WORDS, capacity=64).collect()
    n = check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 64)
    assert n <= 1.02 * sum(r["length"] for r in rows) / 64 + 2
    assert Counter(map(tuple, rows)) == Counter(map(tuple, packing.pack(docs, WORDS, capacity=64).collect()))
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), WORDS).collect() == []


def test_exchanges_only_add_to_squared_fill_and_empty_sequences():
    r = random.Random(5)
    for _ in range(60):
        lengths = [r.randint(5, 60) for _ in range(r.randint(1, 60))]
        bins = [[p] for p in range(len(lengths))]  # as bad as can be
        search = packing.Exchange([list(b) for b in bins], lengths, 100)
        squares, swap = [sum(n * n for n in lengths)], search._swap

        def spy(*move):
            swap(*move)
            assert search.fill == [sum(lengths[p] for p in b) for b in search.bins] and max(search.fill) <= 100
            squares.append(sum(f * f for f in search.fill))

        search._swap = spy
        least = packing.lower_bound(np.array(lengths), 100)
        search.run(least, 10**6)
        assert all(x < y for x, y in itertools.pairwise(squares))
        left = [b for b in search.bins if b]
        assert sorted(p for b in left for p in b) == list(range(len(lengths)))
        assert least <= len(left) <= len(packing.best_fit(lengths, 100)) + 1


def test_exchange_betters_best_fit():
    """Never more sequences than longest first leaves, and at times fewer."""
    worse = 0
    r = random.Random(9)
    for _ in range(300):
        lengths = [r.randint(15, 50) for _ in range(24)]
        a, b = len(packing.best_fit(lengths, 100)), len(packing.packed(lengths, 100))
        assert b <= a
        worse += b < a
    assert worse > 0

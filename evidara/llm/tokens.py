"""Token ids of whole texts from tokenizer files.

Encoding is by parts: a text is cut where no token can reach across, and a worker encodes each distinct
part once as long as it remembers it. Memory follows the slice in hand, never the text's length.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import sentencepiece
import tiktoken
import tokenizers

#: Parts that a worker remembers, and the bytes of the longest of them.
REMEMBERED, LONGEST = 600_000, 64
#: Bytes of text whose parts are handled at once; one longer part makes a slice of its own.
SLICE = 1 << 20


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """What make() gave when this worker process first asked for the key; Spark runs many tasks in one process."""
    store = vars(tokenizers).setdefault("kept_by_worker", {})
    if key not in store:
        store[key] = make()
    return store[key]


def sliced(raw: bytes, edge: re.Pattern[bytes]) -> Iterator[bytes]:
    """raw in slices of about SLICE bytes that begin where `edge` matches."""
    at = 0
    while len(raw) - at > SLICE:
        m = edge.search(raw, at + SLICE)
        if not m:
            break
        yield raw[at : m.start()]
        at = m.start()
    yield raw[at:] if at else raw


def id_code(size: int) -> str:
    """The array code that holds the ids of a vocabulary."""
    return "H" if size <= 1 << 16 else "I"


#: A blank between two characters that cannot be white space themselves: tokens of either vocabulary begin there.
BLANK = re.compile(rb"(?<=[\x21-\x7e]) (?=[\x21-\x7e\xc3])")
#: Characters up to U+00FF, which all versions of Unicode class alike.
PLAIN = re.compile(rb"(?:[\x00-\x7f]|[\xc2\xc3][\x80-\xbf]){1,1000}")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class TwoVocabularies:
    """Ids of the same text by a byte-level BPE file (A) and a sentencepiece BPE model (B)."""

    def __init__(self, a_path: str, b_path: str, pattern: str) -> None:
        with open(a_path) as f:
            spec = json.load(f)
        added, alphabet = {t["id"] for t in spec["added_tokens"]}, byte_alphabet()
        self.a_bytes = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in added}
        self.whole = tokenizers.Tokenizer.from_file(a_path)
        self.whole.encode_special_tokens = True
        # the same merges by rank; only for characters of which no library's Unicode tables differ
        self.ranked = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={t: i for i, t in self.a_bytes.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(size)]
        self.b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        self.cut = not any("▁" in p.lstrip("▁") for p in pieces)  # else a piece may reach across a blank
        self.sizes = (max(self.a_bytes) + 1, size)
        self.memo: dict[bytes, tuple[bytes, bytes] | bool] = {}

    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of each token of A and of B."""
        out = []
        for size, table in zip(self.sizes, (self.a_bytes, self.b_bytes), strict=True):
            n = np.zeros(size, np.int64)
            n[list(table)] = [len(t) for t in table.values()]
            out.append(n)
        return out[0], out[1]

    def _learn(self, parts: list[bytes]) -> dict[bytes, tuple[bytes, bytes] | bool]:
        """Ids of ' ' + part by A and of part by B, or False where one of them does not give these bytes back."""
        texts = [p.decode(errors="replace") for p in parts]
        code_a, code_b = (id_code(n) for n in self.sizes)
        of_a, of_b, ranked = self.a_bytes.__getitem__, self.b_bytes.__getitem__, self.ranked.encode_ordinary
        out: dict[bytes, tuple[bytes, bytes] | bool] = {}
        for part, text, b in zip(parts, texts, self.b.encode(texts, num_threads=1), strict=True):
            whole = b" " + part
            if len(part) <= 1000 and (part.isascii() or PLAIN.fullmatch(part)):
                a = ranked(" " + text)  # by its construction of the same bytes
                same = b"".join(map(of_b, b)) == whole
            else:
                a = self.whole.encode(" " + text, add_special_tokens=False).ids
                same = b"".join(map(of_a, a)) == whole == b"".join(map(of_b, b))
            out[part] = (array(code_a, a).tobytes(), array(code_b, b).tobytes()) if same else False
        return out

    def encode(self, raw: bytes) -> Iterator[tuple[int, tuple[bytes, bytes] | None]]:
        """(first byte, (A's ids, B's ids)) of ' ' + raw slice by slice, both of the same bytes; None for ids that are not."""
        start = 0
        first = True
        for piece in sliced(raw, BLANK) if self.cut else [raw]:
            parts = BLANK.split(piece if first else piece[1:]) if self.cut else [piece]
            first = False
            ids = list(map(self.memo.get, parts))
            if None in ids:
                found = self._learn(list({p for p, i in zip(parts, ids, strict=True) if i is None}))
                ids = [found[p] if i is None else i for p, i in zip(parts, ids, strict=True)]
                if len(self.memo) + len(found) > REMEMBERED:
                    self.memo.clear()
                self.memo.update((p, v) for p, v in found.items() if len(p) <= LONGEST)
            yield start, None if False in ids else (b"".join([i[0] for i in ids]), b"".join([i[1] for i in ids]))
            start += len(piece) + (not start)


#: White space that every library takes for it; tokens of a vocabulary that drops white space end there.
GAP = re.compile(rb"[ \t\n\r\x0b\x0c]")
#: Pretokens of lower-case characters up to U+00FF; their white space (U+0085, U+00A0) is in none.
WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^a-z0-9ªµºß-öø-ÿ²³¹¼½¾\x85\xa0]+")
#: Stands for a word's end in the ranks; no UTF-8 text has this byte.
WORD_END = b"\xff"


class Memo(dict):
    """A function's values by key, worked out when they are first asked for."""

    def __init__(self, of: Callable[[Any], Any]) -> None:
        super().__init__()
        self.of = of

    def __missing__(self, key: Any) -> Any:
        value = self[key] = self.of(key)
        return value


class WordVocabulary:
    """Ids of texts by a BPE file with word ends that lower-cases and drops white space."""

    def __init__(self, path: str) -> None:
        self.whole = tokenizers.Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        vocabulary, end, alphabet = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"], byte_alphabet()
        added = {t["content"] for t in spec["added_tokens"]}
        plain = lambda t: bytes(alphabet[c] for c in t)
        ranks = {plain(t.removesuffix(end)) + WORD_END * t.endswith(end): i for t, i in vocabulary.items() if t not in added and t != alphabet_end(alphabet)}
        merged = [vocabulary["".join(m)] for m in spec["model"]["merges"]]
        # ids ascend with the merges, so merging by id is merging in order
        ascending = all(x < y for x, y in zip(merged, merged[1:], strict=False)) and max(ranks[bytes([b]) + WORD_END] for b in range(255)) < merged[0]
        self.ranked = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks | {WORD_END: len(vocabulary)}, special_tokens={}) if ascending else None
        self.memo = Memo(self._chunk)

    def _chunk(self, chunk: bytes) -> bytes:
        """Ids of a chunk without white space between."""
        if self.ranked is None or b"<|" in chunk or len(chunk) > 1000 or not (chunk.isascii() or PLAIN.fullmatch(chunk)):  # special tokens and other scripts are left to the tokenizer
            return array("I", self.whole.encode(chunk.decode(errors="replace"), add_special_tokens=False).ids).tobytes()
        ids: list[int] = []
        for word in WORD.findall(chunk.decode().lower()):
            ids += self.ranked._encode_single_piece(word.encode() + WORD_END)
        return array("I", ids).tobytes()

    def encode(self, raw: bytes) -> Iterator[np.ndarray]:
        """Ids of raw, slice by slice."""
        for piece in sliced(raw, GAP):
            yield np.frombuffer(b"".join(map(self.memo.__getitem__, piece.split())), np.uint32)
            if len(self.memo) > REMEMBERED:
                self.memo.clear()


def alphabet_end(alphabet: dict[str, int]) -> str:
    """The character of the byte that stands for a word's end, which no text has."""
    return next(c for c, b in alphabet.items() if b == WORD_END[0])

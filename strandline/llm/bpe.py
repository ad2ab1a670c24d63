"""BPE encoding and decoding of words with end marks, by a contiguous array of part boundaries and adjacent ranks."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .words import tidy

#: Words of more symbols than this take a heap instead of repeated scans.
SHORT = 128
#: Ids are below 2 ** BITS. A pair is one number, and so are a rank and the id that its merge makes.
BITS = 20
NEVER = 1 << 60
#: Words that a worker remembers, and characters that one of them has at most; the memory, some 250 MB at most, is emptied
#: when it is full.
REMEMBERED = 600_000
REMEMBERED_LENGTH = 64

# Fixed values of the vocabulary's file format: white space of the normaliser, and the pattern that finds words.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + SPACE + r"\p{L}\p{N}]+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 for itself, all others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A BPE vocabulary read from a tokenizers JSON file: NFC, lower case, white space dropped, words with an end mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or spec["normalizer"] is None:
            raise ValueError("a BPE vocabulary with an end-of-word suffix is needed")
        self.end: str = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.ids | self.special).items()}
        self.ranks: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(self.ids[a] << BITS | self.ids[b], rank << BITS | self.ids[a + b])
        self.numbers = {i: str(i) for i in self.names}
        signs = byte_symbols()
        self.inner = [self.ids.get(c) for c in signs]
        self.last = [self.ids.get(c + self.end) for c in signs]
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._word = regex.compile(WORD)
        self._odd = regex.compile("[\x1c-\x1f]")
        self._gap = regex.compile(f"[{SPACE}]+")
        self._known: dict[str, tuple[str, int, str]] = {}
        self._parts: dict[str, list[int]] = {}

    # ---- one word ----

    def merge(self, parts: list[int]) -> list[int]:
        """ids of a word from the ids of its bytes.

        ranks[i] is the rank of the pair (parts[i], parts[i + 1]). The least rank, leftmost first, is looked for by
        scanning; its boundary is deleted and only the two neighbouring ranks are looked up again.
        """
        if len(parts) > SHORT:
            return self._merge_long(parts)
        get, made = self.ranks.get, (1 << BITS) - 1
        ranks = [get(a << BITS | b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NEVER:
                break
            i = ranks.index(low)
            parts[i] = low & made
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(parts[i] << BITS | parts[i + 1], NEVER)
            if i:
                ranks[i - 1] = get(parts[i - 1] << BITS | parts[i], NEVER)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same result by a heap over a linked list: n log n for words of any length."""
        n = len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get(parts[i] << BITS | parts[i + 1])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = r & ((1 << BITS) - 1), False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) >= 0 and (r := self.ranks.get(parts[x] << BITS | parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p, on in zip(parts, alive) if on]

    def word_ids(self, word: str) -> list[int]:
        """ids of a word that the pattern has found. Symbols that the vocabulary lacks are left out."""
        got = self._parts.get(word)
        if got is None:
            raw = word.encode()
            start = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
            got = self.merge([p for p in start if p is not None])
            if len(word) <= REMEMBERED_LENGTH:
                if len(self._parts) >= REMEMBERED:
                    self._parts.clear()
                self._parts[word] = got
        return got

    # ---- whole texts ----

    def _chunk(self, chunk: str) -> list[int]:
        """ids of text without white space."""
        norm = chunk.lower() if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        out: list[int] = []
        for word in self._word.findall(norm):
            out += self.word_ids(word)
        return out

    def _segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """(segment, whether it is a special token), in order."""
        at = 0
        if self._special is not None and "<|" in text:
            for m in self._special.finditer(text):
                yield text[at : m.start()], False
                yield m.group(), True
                at = m.end()
        yield text[at:], False

    def _chunks(self, text: str) -> list[str]:
        return self._gap.split(text) if self._odd.search(text) else text.split()

    def encode(self, text: str | None) -> list[int]:
        """ids of a whole text; null and empty texts have none."""
        out: list[int] = []
        for part, special in self._segments(text or ""):
            if special:
                out.append(self.special[part])
            else:
                for chunk in self._chunks(part):
                    out += self._chunk(chunk)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by one space, special tokens and end marks included; unknown ids are left out."""
        return " ".join([self.names[i] for i in ids if i in self.names])

    def _remember(self, chunk: str) -> tuple[str, int, str]:
        ids = self._chunk(chunk)
        got = (" ".join([self.numbers[i] for i in ids]), len(ids), self.decode(ids))
        if len(chunk) <= REMEMBERED_LENGTH:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[chunk] = got
        return got

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the decimal ids joined by a space, SHA-256 of the decoded text).

        Encodes and decodes chunk by chunk: neither merges nor the joined tokens reach over white space. What a chunk
        without ids leaves is empty and is left out.
        """
        got: list[tuple[str, int, str]] = []
        known = self._known.get
        for part, special in self._segments(text or ""):
            if special:
                got.append((str(self.special[part]), 1, part))
            else:
                got += [known(c) or self._remember(c) for c in self._chunks(part)]
        ids, counts, words = zip(*got) if got else ((), (), ())
        digest = lambda parts: hashlib.sha256(" ".join(filter(None, parts)).encode()).hexdigest()
        return sum(counts), digest(ids), digest(words)


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """The vocabulary at path, read once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_documents(documents: DataFrame, vocabulary: str) -> DataFrame:
    """One row per row of documents (doc_id, text) with doc_id, ids, decoded."""

    def run(batches):
        bpe = loaded(vocabulary)
        for b in batches:
            ids = [bpe.encode(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"]
            )

    return documents.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, ids array<int>, decoded string")


def digest_documents(documents: DataFrame, vocabulary: str) -> DataFrame:
    """One row per row of documents (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256.

    The same encoding and decoding as encode_documents, of which only the digests leave the worker. Null texts are empty:
    no ids, digests of the empty string. No shuffle; other columns are not read.
    """

    def run(batches):
        bpe = loaded(vocabulary)
        for b in batches:
            got = [bpe.digest(t) for t in b["text"].to_pylist()]
            n, ids, text = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return documents.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

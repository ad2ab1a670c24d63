"""Bounded-space online packing of token ids into sequences of a fixed length."""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import byte_symbols
from .words import tidy

LENGTH = 2048
OPEN_WINDOWS = 64
END_ID = 1
#: Partitions whose leftover windows are merged in one task.
MERGED_TOGETHER = 32
# Fixed value: the word pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteTokenizer:
    """ids as the tokenizers library gives them for a byte-level BPE file, without special tokens added.

    Texts of ASCII and the Latin letters below U+0250 take a faster encoder with the same vocabulary; in other texts the
    two libraries' Unicode tables may differ, so those go to the tokenizers library itself.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(byte_symbols())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.path, self._exact = path, None
        self._fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._other = regex.compile("[^\x00-\x1b\x20-\x84\x86-\u024f\u2018-\u201d\u2026]")

    def exact(self, text: str) -> np.ndarray:
        if self._exact is None:
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_file(self.path)
            self._exact.no_truncation()
            self._exact.no_padding()
        return np.array(self._exact.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, text: str) -> np.ndarray:
        if not text.isascii() and self._other.search(text):
            return self.exact(text)
        try:
            return self._fast.encode_to_numpy(text, allowed_special="all").astype(np.uint32, copy=False)
        except ValueError:  # its pattern engine gives up on runs of about a million white space characters
            return self.exact(text)


_LOADED: dict[str, ByteTokenizer] = {}


def loaded(path: str) -> ByteTokenizer:
    if path not in _LOADED:
        _LOADED[path] = ByteTokenizer(path)
    return _LOADED[path]


class Windows:
    """A fixed number of open windows; each piece goes to the fullest window that it still fits, and when none fits and
    all are open, the fullest is emitted to make room for a new one."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.open: list[tuple[int, int]] = []  # (free, window), ascending
        self.next = 0

    def place(self, size: int) -> tuple[int, int]:
        """(window, offset) of a piece of `size` ids, 1 <= size <= length."""
        at = bisect_left(self.open, (size, -1))
        if at < len(self.open):
            free, window = self.open.pop(at)
        else:
            if len(self.open) >= self.most:
                self.open.pop(0)
            free, window = self.length, self.next
            self.next += 1
        if free > size:
            insort(self.open, (free - size, window))
        return window, self.length - free


def cut(tokens: int, length: int) -> Iterator[tuple[int, int]]:
    """(start, size) of a document's pieces: whole windows first, the rest last. Documents that fit stay whole."""
    for start in range(0, tokens, length):
        yield start, min(length, tokens - start)


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, window long, offset long, left boolean"


def _pieces(vocabulary: str, length: int, most: int, end_id: int):
    def run(batches):
        tokenizer, space, part = loaded(vocabulary), Windows(length, most), 0
        end = np.array([end_id], np.uint32)
        waiting: dict[int, list[tuple]] = {}  # pieces of open windows

        def table(rows: list[tuple], left: bool) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * 7
            doc, start, size, crc, tokens, window, offset = (pa.array(c, pa.int64()) for c in cols)
            n = len(doc)
            return pa.RecordBatch.from_arrays(
                [doc, start, size, crc, tokens, pa.array([part] * n, pa.int32()), window, offset, pa.array([left] * n, pa.bool_())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "window", "offset", "left"],
            )

        for b in batches:
            if b.num_rows:
                part = b["part"][0].as_py()
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"]):
                ids = np.concatenate([tokenizer.ids(text.as_py() or ""), end])
                for start, size in cut(len(ids), length):
                    crc = zlib.crc32(ids[start : start + size].astype("<u4").tobytes())
                    window, offset = space.place(size)
                    waiting.setdefault(window, []).append((doc_id, start, size, crc, len(ids), window, offset))
            still = {w for _, w in space.open}
            yield table([row for w in list(waiting) if w not in still for row in waiting.pop(w)], False)
        yield table([row for rows in waiting.values() for row in rows], True)

    return run


def _merge(length: int, parts: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """Leftover pieces, largest first, into the fullest window that they fit; every window stays open here."""
        group, space = key[0].as_py(), Windows(length, 1 << 30)
        rows = rows.sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("part", "ascending"), ("window", "ascending"), ("offset", "ascending")])
        placed = [space.place(n) for n in rows["length"].to_pylist()]
        put = rows.set_column(rows.schema.get_field_index("part"), "part", pa.array([parts + group] * len(placed), pa.int32()))
        put = put.set_column(put.schema.get_field_index("window"), "window", pa.array([w for w, _ in placed], pa.int64()))
        return put.set_column(put.schema.get_field_index("offset"), "offset", pa.array([o for _, o in placed], pa.int64())).drop(["group"])

    return run


def pack(documents: DataFrame, vocabulary: str, length: int = LENGTH, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its text and end_id; null and empty texts are end_id alone. Documents of at most
    `length` ids stay whole; longer ones give full windows and a rest. Each partition keeps `open_windows` windows open;
    what is open at its end is packed anew with the leftovers of MERGED_TOGETHER partitions, largest piece first. Rows are
    tokenized where they are read, and only leftover pieces (numbers, no ids) are shuffled. Other columns are not read.
    """
    # A task may go through several partitions: their numbers come with their rows, not from the task.
    numbered = documents.select("doc_id", "text", F.spark_partition_id().alias("part"))
    rows = numbered.mapInArrow(tidy(_pieces(vocabulary, length, open_windows, end_id)), PIECE)
    pieces = common.written(rows, "pieces")
    parts = (pieces.agg(F.max("part")).first()[0] or 0) + 1
    left = pieces.where("left").withColumn("group", F.floor(F.col("part") / MERGED_TOGETHER).cast("int"))
    merged = left.groupBy("group").applyInArrow(_merge(length, parts), PIECE)
    every = pieces.where("not left").unionByName(merged)
    sequence = F.shiftleft(F.col("part").cast("long"), 32) + F.col("window")
    return every.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence.alias("sequence_id"), "offset")

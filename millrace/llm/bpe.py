"""Encoding of texts with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARIES = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
#: Longer words are merged with a heap.
SHORT_BYTES = 128
#: Words whose ids a worker remembers; beyond, it starts afresh.
REMEMBERED = 400_000
#: Longer words are not remembered.
REMEMBERED_CHARS = 48


def read_ranks(vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> bytes:
    """The rank file, read where the job is planned; about a megabyte."""
    with open(os.path.join(folder, f"{vocabulary}.tiktoken"), "rb") as file:
        return file.read()


def _class(prefix: str) -> str:
    """A character class of all code points of a general category."""
    spans, start = [], None
    for code in range(sys.maxunicode + 2):
        inside = code <= sys.maxunicode and unicodedata.category(chr(code)).startswith(prefix)
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            spans.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return "".join(spans)


#: The white space of Unicode.
BLANKS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _splitter(letters: str, numbers: str) -> re.Pattern:
    """The vocabulary's own pattern, with its classes spelt out."""
    return re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^{BLANKS}{letters}{numbers}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")


class _Known(dict):
    """word -> ids in bytes; an unknown word is encoded and, if short, kept."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(word) <= REMEMBERED_CHARS:
            self[word] = ids
        return ids


class Encoder:
    """text -> ids, as 32-bit integers in bytes."""

    def __init__(self, ranks: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        # No word of the pattern goes on beyond a blank, so a text is first cut
        # into blanks and runs of other characters, which repeat more often.
        self.runs = re.compile(rf" ?[^{BLANKS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+").findall
        self.pattern = _splitter(_class("L"), _class("N")).findall
        self.words = _Known(self.word)
        self.known = _Known(self.run)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text; of an empty or null text, none."""
        if not text:
            return b""
        for known in (self.known, self.words):
            if len(known) >= REMEMBERED:
                known.clear()
        return b"".join(map(self.known.__getitem__, self.runs(text)))

    def run(self, run: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.pattern(run)))

    def word(self, word: str) -> bytes:
        raw = word.encode("utf-8", "replace")
        whole = self.ranks.get(raw)
        if whole is not None:
            return array("i", [whole]).tobytes()
        return array("i", self._short(raw) if len(raw) <= SHORT_BYTES else self._long(raw)).tobytes()

    def _short(self, word: bytes) -> list[int]:
        """starts[i] is where part i begins, pair[i] the rank of parts i and
        i + 1 together. The lowest rank is merged by deleting the boundary
        between its parts; only the two ranks beside it change."""
        ranks, none = self.ranks, 1 << 60
        starts = list(range(len(word) + 1))
        pair = [ranks.get(word[i : i + 2], none) for i in range(len(word) - 1)]
        while pair:
            low = min(pair)
            if low == none:
                break
            at = pair.index(low)
            del starts[at + 1], pair[at]
            if at < len(pair):
                pair[at] = ranks.get(word[starts[at] : starts[at + 2]], none)
            if at:
                pair[at - 1] = ranks.get(word[starts[at - 1] : starts[at + 1]], none)
        return [ranks[word[a:b]] for a, b in zip(starts, starts[1:])]

    def _long(self, word: bytes) -> list[int]:
        """The same merges in the same order, found by a heap."""
        ranks, n = self.ranks, len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, at, end = heapq.heappop(heap)
            if not alive[at] or after[at] >= n or after[after[at]] != end:
                continue
            gone = after[at]
            alive[gone] = False
            after[at] = end
            if end < n:
                before[end] = at
                if (r := ranks.get(word[at : after[end]])) is not None:
                    heapq.heappush(heap, (r, at, after[end]))
            if (left := before[at]) >= 0 and (r := ranks.get(word[left:end])) is not None:
                heapq.heappush(heap, (r, left, end))
        return [ranks[word[i : after[i]]] for i in range(n) if alive[i]]


_encoders: dict[str, Encoder] = {}


def encoder(ranks: bytes) -> Encoder:
    """One encoder per worker process and vocabulary."""
    key = hashlib.sha256(ranks).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(ranks)
    return _encoders[key]


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(key, ids) of every row, without special tokens.

    Texts are taken as they are; the names of special tokens in a text are
    ordinary text. An empty and a null text have an empty list of ids. Rows
    with the same key or text each give a row. No shuffle: the work is spread
    as the files are split.
    """
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(vocabulary, folder))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = encoder(ranks.value).encode
        for batch in batches:
            coded = [run(t) for t in batch.column(1).to_pylist()]
            ends = [0]
            for c in coded:
                ends.append(ends[-1] + len(c) // 4)
            values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(coded))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=["k", "ids"])

    kind = documents.select(key).schema[0].dataType.simpleString()
    return documents.select(key, text).mapInArrow(work, f"k {kind}, ids array<int>").select(F.col("k").alias(key), "ids")


def count_tokens(documents: DataFrame, keep: list[str], text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """The columns ``keep`` and tokens, the number of ids ``encode`` gives."""
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(vocabulary, folder))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = encoder(ranks.value).encode
        for batch in batches:
            n = pa.array([len(run(t)) // 4 for t in batch.column(0).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], n], names=[*keep, "tokens"])

    source = documents.select(F.col(text).alias("_text"), *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:])
    return source.mapInArrow(work, f"{kinds}, tokens int" if kinds else "tokens int")

"""Encoding with a public vocabulary through its own library."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDER = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
# The pattern that splits texts for these vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def _encoding(vocabulary: str, folder: str):
    import tiktoken

    with open(os.path.join(folder, f"{vocabulary}.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(rows: DataFrame, keep: list[str], text: str = "text", vocabulary: str = "byte_bpe_multi_50k", folder: str = FOLDER) -> DataFrame:
    """The columns ``keep`` and tokens; null and empty texts have none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary, folder).encode_ordinary
        for b in batches:
            n = pa.array([len(encode(t)) if t else 0 for t in b.column(0).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], n], names=[*keep, "tokens"])

    source = rows.select(F.col(text).alias("_text"), *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:])
    return source.mapInArrow(work, f"{kinds}, tokens int")


def pretokens(text: str = "text") -> Column:
    """The pieces a text is split into before merging; underscores stay."""
    java = PATTERN.replace(r"\s", r"[\s\x{85}\p{Z}]").replace(r"[^[\s\x{85}\p{Z}]\p{L}\p{N}]", r"[^\s\x{85}\p{Z}\p{L}\p{N}]").replace(r"(?!\S)", r"(?![^\s\x{85}\p{Z}])")
    return F.regexp_extract_all(F.col(text), F.lit(f"({java})"), F.lit(1))


def decode(ids: list[int], vocabulary: str = "byte_bpe_multi_50k", folder: str = FOLDER) -> str:
    """The text of ids; bytes that make no character become replacements."""
    return _encoding(vocabulary, folder).decode(ids, errors="replace")

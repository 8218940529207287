"""Estimated tokens of every document, and totals per slice of a corpus."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import bpe, sampling

#: Documents per language that are tokenized, at most.
SAMPLE = 600
#: With fewer documents a language takes the model, or the bias, of all.
ENOUGH = 40

# Languages and their other codes.
LANGUAGES = {
    "en": "eng english", "fr": "fra fre french", "de": "deu ger german", "es": "spa spanish", "ru": "rus russian", "zh": "zho chi chinese", "ja": "jpn japanese", "th": "tha thai",
    "ar": "ara arabic", "ur": "urd urdu", "hi": "hin hindi", "bn": "ben bengali bangla", "mr": "mar marathi", "ta": "tam tamil", "te": "tel telugu", "pt": "por portuguese", "it": "ita italian",
    "nl": "nld dut dutch", "pl": "pol polish", "tr": "tur turkish", "ko": "kor korean", "fa": "fas per persian", "uk": "ukr ukrainian", "vi": "vie vietnamese", "id": "ind indonesian",
    "gu": "guj gujarati", "kn": "kan kannada", "ml": "mal malayalam", "pa": "pan punjabi", "el": "ell gre greek", "he": "heb hebrew", "sv": "swe swedish", "cs": "ces cze czech",
}
# First and last code point of scripts.
SCRIPTS = {
    "greek": (0x370, 0x3FF), "cyrillic": (0x400, 0x52F), "hebrew": (0x590, 0x5FF), "arabic": (0x600, 0x77F), "devanagari": (0x900, 0x97F), "bengali": (0x980, 0x9FF), "south": (0xA00, 0xDFF),
    "thai": (0xE00, 0xE7F), "kana": (0x3040, 0x30FF), "han": (0x3400, 0x9FFF), "hangul": (0xAC00, 0xD7AF),
}
KINDS = ["other", "blank", "break", "digit", "punctuation", "small", "large", "latin", "mark", "sign", *SCRIPTS, "beyond"]
#: Kinds whose characters don't go on a word of letters, and each its own run.
APART = ["blank", "break", "digit", "punctuation", "mark", "sign"]
FEATURES = ["bytes", "words", "runs", *KINDS]


@cache
def _kinds() -> np.ndarray:
    """The kind of each code point of the first plane."""
    table = np.zeros(1 << 16, np.uint8)
    for code in range(1 << 16):
        c = chr(code)
        category = unicodedata.category(c)
        if c == "\n":
            kind = "break"
        elif c.isspace():
            kind = "blank"
        elif category == "Nd":
            kind = "digit"
        elif category[0] in "PS":
            kind = "punctuation"
        elif category[0] == "M":
            kind = "sign" if 0x900 <= code < 0xE80 else "mark"
        else:
            kind = next((s for s, (a, b) in SCRIPTS.items() if a <= code <= b), None)
            if kind is None and category[0] == "L" and code < 0x250:
                kind = ("large" if c.isupper() else "small") if code < 128 else "latin"
        table[code] = KINDS.index(kind or "other")
    return table


@cache
def _groups() -> np.ndarray:
    return np.array([APART.index(k) + 1 if k in APART else 0 for k in KINDS], np.uint8)


def features(text: str | None) -> np.ndarray:
    """Counts of FEATURES in a text; zeros for a null or empty one."""
    out = np.zeros(len(FEATURES))
    if not text:
        return out
    raw = text.encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(raw, np.uint32)
    kinds = _kinds()[np.minimum(codes, 0xFFFF)]
    out[3:] = np.bincount(kinds, minlength=len(KINDS))
    beyond = int((codes > 0xFFFF).sum())
    out[-1] = beyond
    group = _groups()[kinds]
    out[2] = 1 + int((group[1:] != group[:-1]).sum())
    blank = (kinds == 1) | (kinds == 2)
    out[1] = int((blank[:-1] & ~blank[1:]).sum()) + (not blank[0])
    out[0] = len(codes) + int((codes > 0x7F).sum()) + int((codes > 0x7FF).sum()) + beyond
    return out


def language(column: str = "lang") -> Column:
    """The two-letter code of a language tag however it is written; ``und``
    for null, empty and unknown ones. So there are no more than a few dozen."""
    tag = F.lower(F.split(F.trim(F.coalesce(column, F.lit(""))), "[-_]")[0])
    known = F.create_map(*[F.lit(x) for code, names in LANGUAGES.items() for name in [code, *names.split()] for x in (name, code)])
    return F.coalesce(F.try_element_at(known, tag), F.lit("und"))


class Model:
    """Per language: weights of the features, and the factor that corrects the
    sum of its estimates; under ``*`` those of all languages together."""

    def __init__(self):
        self.weights: dict[str, np.ndarray] = {}
        self.factor: dict[str, float] = {}

    def fit(self, rows: list[tuple[str, int, np.ndarray, int]]) -> Model:
        """rows: language, rank in the sample, features, tokens. Every third of
        a language is held out to correct the bias, the others are fitted."""
        groups = {"*": rows} | {lang: [r for r in rows if r[0] == lang] for lang in {r[0] for r in rows}}
        for lang, own in groups.items():
            inside, outside = [r for r in own if r[1] % 3], [r for r in own if not r[1] % 3]
            if len(inside) >= ENOUGH or lang == "*" and inside:
                x = np.array([r[2] for r in inside], float)
                y = np.array([r[3] for r in inside], float)
                scale = np.sqrt(np.maximum(y, 1.0))
                size = np.maximum(x.std(axis=0), 1e-9)
                a = x / size / scale[:, None]
                self.weights[lang] = np.linalg.solve(a.T @ a + 0.01 * np.eye(x.shape[1]), a.T @ (y / scale)) / size
            if lang in self.weights or lang == "*":
                guess = sum(self.raw(lang, r[2]) for r in outside)
                if len(outside) >= ENOUGH // 2 and guess > 0:
                    self.factor[lang] = sum(r[3] for r in outside) / guess
        return self

    def raw(self, lang: str, x: np.ndarray) -> float:
        weights = self.weights.get(lang, self.weights.get("*"))
        return max(0.0, float(x @ weights)) if weights is not None else x[0] / 4

    def tokens(self, lang: str, x: np.ndarray) -> int:
        factor = self.factor.get(lang if lang in self.weights else "*", 1.0)
        return int(round(self.raw(lang, x) * factor)) if x[0] else 0


def fit(documents: DataFrame, key: str = "doc_id", sample: int = SAMPLE, vocabulary: str = "byte_bpe_50k", folder: str = bpe.VOCABULARIES) -> Model:
    """Fit and correct on at most ``sample`` tokenized documents per language."""
    chosen = sampling.by_group(documents.where(F.coalesce(F.octet_length("text"), F.lit(0)) > 0), language(), key, sample, ["text"])
    ranks = documents.sparkSession.sparkContext.broadcast(bpe.read_ranks(vocabulary, folder))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.encoder(ranks.value).encode
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = pa.array([features(t).tolist() for t in texts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found, pa.array([len(encode(t)) // 4 for t in texts], pa.int32())], names=["language", "rank", "x", "tokens"])

    rows = chosen.select(F.col("group").alias("language"), "rank", "text").mapInArrow(work, "language string, rank int, x array<double>, tokens int").collect()
    return Model().fit([(r["language"], r["rank"], np.array(r["x"]), r["tokens"]) for r in sorted(rows, key=lambda r: (r["language"], r["rank"]))])


def estimate(documents: DataFrame, keep: list[str], model: Model) -> DataFrame:
    """The columns ``keep`` with tokens, estimated from counts of the text.

    A null or empty text has 0 tokens; a language the model doesn't know, or
    none, takes the model of all. Repeated rows are estimated alike. The model
    is a few kilobytes per language, and languages are a fixed list. No shuffle.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in batches:
            n = [m.tokens(lang, features(t)) for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(n, pa.int64())], names=[*keep, "tokens"])

    source = documents.select(language().alias("_language"), F.col("text").alias("_text"), *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[2:])
    return source.mapInArrow(work, f"{kinds}, tokens long")


def errors(exact: DataFrame, estimated: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per language: tokens counted and estimated, how far the sum is off, and
    how far a document is on average.

    exact: key, language, tokens; estimated: key, tokens; keys are unique.
    Documents that count no tokens, or are in one table only, are left out.
    """
    both = exact.where(F.col("tokens") > 0).join(estimated.select(key, F.col("tokens").alias("_guess")), key)
    off = F.abs(F.col("_guess") - F.col("tokens")) / F.col("tokens")
    sums = both.groupBy("language").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("counted"), F.sum("_guess").alias("estimated"), F.round(F.avg(off), 6).alias("mean_error"))
    return sums.withColumn("bias", F.round(F.col("estimated") / F.col("counted") - 1, 6))


def slices(estimated: DataFrame) -> DataFrame:
    """Documents and tokens by source, language and domain."""
    return estimated.groupBy("source", language().alias("language"), "domain").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))


def script(column: str = "script") -> Column:
    """The four-letter code of a script tag; null for missing ones."""
    tag = F.initcap(F.trim(column))
    return F.when(tag.isin("", "Zyyy", "Zzzz", "None"), None).otherwise(tag)


def by_segment(estimated: DataFrame, segments: DataFrame) -> DataFrame:
    """A document's tokens, shared out over the lane, language and script of
    its segments in proportion to the tokens these span.

    Exact duplicate segments count once; null lanes and scripts make groups of
    their own; documents without segments aren't in it.
    """
    span = F.greatest(F.col("token_end") - F.col("token_start"), F.lit(0))
    unique = segments.select("sample_id", "seg_no", "doc_id", "token_start", "token_end", "lane", "lang", "script").distinct()
    part = unique.groupBy("doc_id", "lane", language().alias("language"), script().alias("script")).agg(F.sum(span).alias("span"), F.count(F.lit(1)).alias("segments"))
    whole = part.groupBy("doc_id").agg(F.sum("span").alias("_whole"))
    joined = estimated.select("doc_id", "tokens").join(part, "doc_id").join(whole, "doc_id")
    share = F.when(F.col("_whole") > 0, F.col("tokens") * F.col("span") / F.col("_whole")).otherwise(0.0)
    return joined.groupBy("lane", "language", "script").agg(F.sum("segments").alias("segments"), F.sum("span").alias("span_tokens"), F.round(F.sum(share), 3).alias("document_tokens"))

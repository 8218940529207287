"""Text functions as column expressions; only NFC needs Python."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space as str.strip() has it, and characters to remove.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
INVISIBLE = r"[\x{feff}\x{ad}\x{2060}\x{200b}\x{200e}\x{200f}]"
WORD = r"([\p{L}\p{N}_]+)"
CANARY = r"(EVAL-CANARY-[0-9a-zA-Z\-]+)"
GRAM = 8
# Scripts in alphabetical order, which settles ties.
SCRIPTS = {
    "Beng": r"[\x{980}-\x{9FF}]", "Deva": r"[\x{900}-\x{97F}]", "Gujr": r"[\x{A80}-\x{AFF}]",
    "Latn": r"[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]", "Taml": r"[\x{B80}-\x{BFF}]", "Telu": r"[\x{C00}-\x{C7F}]",
}


def words(text: str = "text") -> Column:
    """The words in small letters; a capital I with a dot becomes a plain one."""
    return F.regexp_extract_all(F.lower(F.translate(text, "\u0130", "i")), F.lit(WORD), F.lit(1))


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.col(text), F.lit(WORD))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def normalize(text: str = "text") -> Column:
    """Line ends, invisible characters, NFC, trailing blanks, runs of empty
    lines; ends in one line end. Joiners stay, and doing it twice is the same
    as once. Null stays null."""
    plain = F.regexp_replace(F.regexp_replace(F.col(text), r"\r\n?", "\n"), INVISIBLE, "")
    trimmed = F.regexp_replace(nfc(plain), r"[ \t]+(?=\n)", "")
    return F.concat(strip(F.regexp_replace(trimmed, r"\n{3,}", "\n\n")), F.lit("\n"))


def script_of(text: str = "text") -> Column:
    """The script with the most letters, by block; Zyyy if there are none."""
    n = {s: F.regexp_count(F.col(text), F.lit(p)) for s, p in SCRIPTS.items()}
    most = F.greatest(*n.values())
    out = F.when(most == 0, "Zyyy")
    for s, c in n.items():
        out = out.when(c == most, s)
    return F.when(F.col(text).isNotNull(), out)


def grams(text: str = "text", n: int = GRAM) -> Column:
    """The distinct runs of n words; of fewer words, all of them as one.

    The words are bound to a variable of a one-element array, as an expression
    named inside a higher-order function is evaluated anew for each element.
    """

    def runs(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, every).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(F.array(words(text)), runs)))


def gram_hashes(text: str = "text", n: int = GRAM) -> Column:
    """64-bit hashes of the grams: of their words as arrays, which costs less
    than to write each gram out."""

    def runs(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.slice(w, i, n)))
        return F.when(F.size(w) >= n, every).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return F.array_distinct(F.flatten(F.transform(F.array(words(text)), runs)))


def fingerprint(gram: Column) -> Column:
    """Of a full run the first 16 digits of its hash, of a short text all 64."""
    full = F.size(F.split(gram, " ")) >= GRAM
    return F.when(full, F.substring(F.sha2(gram, 256), 1, 16)).otherwise(F.sha2(gram, 256))


def canaries(text: str = "text") -> Column:
    return F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(CANARY), F.lit(1)))

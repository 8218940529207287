"""Sentence boundaries across languages and scripts."""

from __future__ import annotations

import math
import pickle
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.budget import language
from millrace.session import kept

# Words before a full stop. They are where the log-odds start
# from; what a corpus shows of them is learnt in Model.fit.
#: Abbreviations that stand before what they belong to and end no sentence.
LEADING = set(
    "dr prof mt st mr mrs ms sq cu fig figs sec secs no nos vol vols eq eqs thm prop def lem cor ch cf vs e.g i.e eg ie approx pp ca nr abb bzw bspw vgl tab kap sog evtl inkl hr fr gen col capt lt sgt rev hon ave "
    "jan feb mar apr jun jul aug sep sept oct nov dec sr sra srta dra ud uds pág págs núm aprox ej ex env mme mlle mm art éd p "
    "рис проф см стр гл тыс ул им акад табл руб пр पृ डॉ क्र श्री ড ডা ডঃ পৃ సం డా పే எண் திரு டாக்டர் பக் د ا.د ص ڈ ش".split()
)
#: Abbreviations that end a sentence if the next word is written large.
CLOSING = set("etc usw al.etc т.д т.п др u.s.w".split())
#: Abbreviations that end one only before a word that opens sentences.
EITHER = set("a.m p.m am pm ltd inc co corp jr bros al q.e.d u.s u.k e.u n.b г гг в вв".split())
#: Words that open sentences.
OPENERS = set(
    "the a an if although though what when while despite because since over under next until between during with without on in at by for from after before as no nobody none each every who whose why how where which is are was were do does did has have can could will would it its he she they we i you my your our his her their this these that those there here let see according most some many several few one two three four five and but or so then thus hence however not only both either neither once all any such other another yes dr prof mr mrs st mt version cf also now "
    "der die das den dem des ein eine einen einem einer im am an auf nach seit bis vor bei mit ohne wenn weil obwohl warum wie wo wer ist sind und aber oder es er sie wir ihr ich nicht kein keine laut unter über zwischen während zum zur für um trotz durch gegen "
    "le la les un une des du de en dans sur sous selon avant après depuis pendant sans avec pourquoi si quand il elle ils elles ce cet cette ces on nous vous je et mais ou au aux à chaque par pour comment d l c qu "
    "el los las una unos del desde según sin con tras bajo por para cuando antes después cada y pero al lo qué cómo dónde quién "
    "в на с со и но до после по под без за к ко о об от для из при над перед если когда почему где кто что как это он она оно они мы вы я не каждый каждую каждая все".split()
)
#: Words after an ordinal number in German.
ORDINAL = set("januar februar märz april mai juni juli august september oktober november dezember jahrhundert jahrhunderts jahrtausend tag tages woche stock auflage kapitel".split())
BEFORE_ORDINAL = set("am im vom zum beim seit bis den dem der des".split())

PAIRS = {"«": "»", "„": "“", "“": "”", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》"}
ENDS = {c: o for o, c in PAIRS.items()}
# as long as the text: full-width forms of ASCII and returns become what they stand for
_narrow = {0xFF01 + i: 0x21 + i for i in range(94)} | {0xFF61: 0x3002, 0x0D: 0x0A}
del _narrow[0xFF08], _narrow[0xFF09]
_wide = re.compile("[\uff01-\uff5e\uff61\r]")
_marks = re.compile("[\u0300-\u036f\u00ad\u200b-\u200d\u2060\ufeff]")
_gap = re.compile(r"\n[^\S\n]*\n\s*")
_item = re.compile(r"[^\S\n]*(?:[-*•·‣◦+]|\(?\d{1,4}[.)]|\(?[a-zA-Z][)])[^\S\n]+\S")
_bullet = re.compile(r"[^\S\n]*[-*•·‣◦]\s")
_title = re.compile(r"[^\S\n]*#{1,6}\s")
_paired = re.compile(r"""["«»„“”「」『』()（）\[\]【】《》]""")
_stops = re.compile(r"[.!?…。．！？।॥۔؟]+(?:[^\S\n]?[!?।॥])*|\|(?<=[\sऀ-෿]\|)(?=\s|$)")
_thai = re.compile(r"(?<=[\u0e00-\u0e7f])\s+(?=[\u0e00-\u0e7f])|(?<=[\u0e00-\u0e7f0-9%])\s+(?=[\u0e00-\u0e7f])|(?<=[\u0e00-\u0e7f])\s+(?=[0-9])")
_has_thai = re.compile(r"[\u0e00-\u0e7f]")
_before = re.compile(r"""[^\s"“”„«»「」()（）\[\]]*\Z""")
_quoting = re.compile(r"""["“”„«»「」()（）\[\]]""")
_word = re.compile(r"[^\W\d_]+")
_written = re.compile(r"[^\W\d_][^\s.,;:!?…。．！？।॥۔؟،؛()«»„“”「」『』\"]*")
_initials = re.compile(r"(?:[^\W\d_]\.)*[^\W\d_]\Z")
_inner = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]")

STRONG, STOP, BREAK = 5.0, 3.0, 30.0
#: Log-odds of a place that the rules of spelling speak against.
AGAINST = -6.0
#: What it costs to end a sentence inside a quotation or bracket, and to take
#: a straight quotation mark for a stray one.
INSIDE, STRAY = 14.0, 6.0
#: How strongly weights are drawn to 0.
PULL = 1.0
#: Characters of text whose places are kept in one row.
PART_CHARS = 4_000_000
#: Kinds of places up to which the driver fits the weights itself; with more,
#: each round is a job that gives the same sums.
LOCAL_PLACES = 500_000
#: Slopes are rounded to multiples of this, so that their sums are exact in
#: whatever order they are taken.
GRAIN = 2.0**-20


# Opening marks that a closing mark can belong to.
_OPENERS = {'"': '"', "”": "“„", "“": "„", "«": "»"} | {c: o for c, o in ENDS.items() if c not in "”“«"}


def _pairs(text: str, lo: int, hi: int) -> dict[int, int]:
    """Place of each closing mark -> place of its opening one, at any distance."""
    stack: list[tuple[str, int]] = []
    waiting: Counter[str] = Counter()
    out: dict[int, int] = {}
    for m in _paired.finditer(text, lo, hi):
        c, at = m.group(), m.start()
        closes = [o for o in _OPENERS.get(c, "") if waiting[o]]
        if c == '"' and closes and at > lo and text[at - 1].isspace():
            # a quotation mark after a blank and before a letter opens another
            after = text[at + 1 : at + 2]
            if after and not after.isspace():
                closes = []
        if closes:
            while stack:
                opened, where = stack.pop()
                waiting[opened] -= 1
                if opened in closes:
                    out[at] = where
                    break
        elif c in PAIRS or c in '"»':
            stack.append((c, at))
            waiting[c] += 1
    return out


def _blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole): stretches that no sentence crosses; a whole one
    (a list line, a heading) is one sentence."""
    at, n = 0, len(text)
    for m in [*_gap.finditer(text), None]:
        lo, hi = at, m.start() if m else n
        at = m.end() if m else n
        if not ("\n" in text[lo:hi] or _item.match(text, lo) or _title.match(text, lo)):
            yield lo, hi, False
            continue
        lines, p = [], lo
        while p < hi:
            q = text.find("\n", p, hi)
            q = hi if q < 0 else q
            lines.append((p, q))
            p = q + 1
        listed = [bool(_item.match(text, a, b)) for a, b in lines]
        start, run, previous = None, False, ""
        for k, (a, b) in enumerate(lines):
            alone = k == 0 or run or previous.endswith((":", "：")) or (_bullet.match(text, a) and k + 1 < len(lines) and listed[k + 1])
            if listed[k] and alone:
                if start is not None:
                    yield start, lines[k - 1][1], run
                start, run = a, True
            elif _title.match(text, a):
                if start is not None:
                    yield start, lines[k - 1][1], run
                yield a, b, True
                start, run = None, False
            elif start is None:
                start, run = a, False
            elif run and not text[a : a + 1].isspace():
                yield start, lines[k - 1][1], True
                start, run = a, False
            previous = text[a:b].rstrip()
        if start is not None:
            yield start, hi, run


class _Cut:
    """A place where a sentence may end: the end of its closing marks, the
    start of the next, the log-odds that the spelling gives it, the features
    that the model weighs, the opening word, how many pairs of marks it lies
    inside of and how many straight quotation marks stand before it."""

    __slots__ = ("end", "start", "rule", "features", "opening", "inside", "quotes")

    def __init__(self, end: int, start: int, rule: float, features: tuple[str, ...] = (), opening: str = ""):
        self.end, self.start, self.rule, self.features, self.opening, self.inside, self.quotes = end, start, rule, features, opening, 0, 0


def _first_word(text: str, at: int, hi: int) -> str:
    """The word that opens at a place, behind its marks, as it is written; two
    characters of it in scripts without spaces, nothing for a number."""
    while at < hi and not text[at].isalnum() and not text[at].isspace():
        at += 1
    m = _written.match(text, at, min(hi, at + 60))
    return "" if not m else m.group()[:2] if _inner.match(m.group()) else m.group()


def _opening(text: str, at: int, hi: int) -> tuple[str, str, str]:
    """Kind of the next word, the word in small letters, and the marks before it."""
    p = at
    while p < hi and not text[p].isalnum() and not text[p].isspace():
        p += 1
    marks = text[at:p]
    if p < hi and text[p].isspace() and marks and marks[-1] in "«—–-\"“„":
        while p < hi and text[p].isspace():
            p += 1
    if p >= hi or text[p].isspace():
        return "none", "", marks
    c = text[p]
    if c.isdigit():
        return "digit", "", marks
    m = _word.match(text, p, hi)
    word = m.group() if m else c
    if c.isupper() or c.istitle():
        return "upper", word.lower(), marks
    return ("lower" if c.islower() else "plain"), word.lower(), marks


def _token(text: str, lo: int, at: int) -> str:
    """What stands before a place, from the last blank, quotation mark or bracket on."""
    near = text[max(lo, at - 40) : at]
    if not near or near[-1].isspace():
        return ""
    token = near.rsplit(None, 1)[-1]
    return _before.search(token).group() if _quoting.search(token) else token


@lru_cache(1 << 16)
def _bare(token: str) -> tuple[str, bool]:
    """A token in small letters behind its last apostrophe, and whether it is initials."""
    bare = re.split("[’']", _marks.sub("", unicodedata.normalize("NFC", token)).lower())[-1] if token else ""
    return bare, bool(_initials.match(bare))


@lru_cache(1 << 16)
def _shape(token: str) -> tuple[str, str]:
    """A token in small letters, two of them in scripts without spaces, and its shape."""
    bare = token.lower() if token.isascii() else _marks.sub("", token).lower()
    if _inner.match(bare[-1:]):
        return bare[-2:], "inner"
    return bare, "none" if not bare else "digits" if bare.isdigit() else "letter" if len(bare) == 1 else "dotted" if "." in bare else "short" if len(bare) < 4 else "word"


def _spelling(text: str, lo: int, hi: int, m: re.Match, end: int, start: int, opening: tuple[str, str, str], quoted: int | None) -> float | None:
    """Whether the spelling speaks for an end at ``end`` and a start at
    ``start``, as log-odds; None if it speaks against it."""
    stop = m.group()
    s = m.start()
    after = text[start]
    if after in ",;:،、，；：%‰" or (after in "><=+*/^" and stop[0] in "!?"):
        return None
    near = end == start
    kind, word, marks = opening
    dashed = after in "—–-"
    if dashed and not (kind == "upper" or "¿" in marks or "¡" in marks):
        return None
    pause = stop.startswith(("..", "…"))
    single = stop == "."
    token = _token(text, lo, s) if single or stop == "!" else ""
    if quoted is not None:
        # words that follow a quotation directly name its speaker
        opener = text[quoted]
        if kind == "lower":
            return None
        if kind == "plain":
            if opener in "(（[【":
                b = text[lo:quoted].rstrip()
                if b and not _stops.search(b[-1]):
                    return None
            elif stop[-1] not in ".。।॥۔|" or word.startswith("と"):
                return None
            elif after in "とっ":
                return None
        elif kind == "none" and not marks:
            return None
    if kind == "lower" and stop == "!" and len(_marks.sub("", token)) <= 2:
        return None
    fit = 0.0
    if pause:
        if kind in ("lower", "plain") and not any(x in marks for x in "\"“«「¿¡"):
            return None
        return 2.0
    if not single:
        fit = STRONG if kind != "lower" else 2.0
        if near and kind == "lower" and not _inner.match(text[s - 1 : s]):
            return None
        return fit
    bare, initials = _bare(token)
    if near:
        # "end.Next", but not "3.5", "name.py" or "D.V."
        if kind == "plain":
            return STOP if not bare[-1:].isdigit() and bare not in LEADING else None
        if quoted is None and (kind != "upper" or len(bare) < 2 or initials and len(bare) > 1 and "." in bare):
            return None if not (kind in ("none",) and marks) else None
        if quoted is None and not (token[-1:].islower() or token[-1:].isdigit() or len(token) > 3):
            return None
    if quoted is None and bare:
        last = bare.rsplit(".", 1)[-1] if not initials else bare
        head = text[max(lo, s - len(token) - 24) : s - len(token)].split()
        prev = head[-1].lower() if head else ""
        if bare in CLOSING or (prev + bare) in CLOSING:
            return 2.0 if kind in ("upper", "plain") or marks else None
        if bare in EITHER:
            return (1.5 if kind == "upper" and word in OPENERS else None) if kind != "plain" else None
        if bare in LEADING or last in LEADING and "." in bare:
            return None
        if initials and not bare.isdigit():
            if kind == "plain" or kind == "lower":
                return None if kind == "lower" or len(bare) < 3 else STOP
            return 1.5 if kind == "upper" and word in OPENERS and token[-1].isupper() else (None if kind == "upper" else 0.5)
        if bare.isdigit():
            if kind == "upper" and (word in ORDINAL or prev in BEFORE_ORDINAL and word not in OPENERS):
                return None
            if kind == "lower" and prev in BEFORE_ORDINAL:
                return None
    fit = STOP
    if kind == "upper":
        fit += 1.0 + (word in OPENERS) * 0.5
    elif kind == "lower":
        fit -= 1.6
    return fit


def _features(text: str, lo: int, m: re.Match, opening: tuple[str, str, str], quoted: int | None) -> tuple[str, ...]:
    """What the model weighs: the closing word and its shape, the case of what
    opens next, and the quotation or bracket that closes here."""
    stop, s = m.group()[-1], m.start()
    kind, word, marks = opening
    token = _token(text, lo, s)
    bare, shape = _shape(token)
    out = [f"s{shape} {stop}{kind}{marks[:1]}", f"w{stop}{bare[-24:]}"]
    if quoted is not None:
        before = text[max(lo, quoted - 2) : quoted].strip()[-1:]
        # a block's start is like a stop: an end there is known only in blocks of
        # one sentence, so apart it would seem to be none the more texts are read
        lead = "stop" if quoted == lo or _stops.match(before) else "colon" if before in (":", "：") else "comma" if before in (",", "，", "、") else "inside"
        out.append(f"q{text[quoted]}{stop}{kind}{marks[:1]} {lead}")
    if shape in ("digits", "letter", "dotted"):
        head = text[max(lo, s - len(token) - 24) : s - len(token)].split()
        out.append(f"p{shape}{head[-1].lower()[-24:] if head else ''}")
        out.append(f"n{shape} {word[:24]}")
    return tuple(out)


def _cuts(text: str, lo: int, hi: int) -> list[_Cut]:
    """Possible ends of sentences in a block, in order; the block's own end last."""
    pairs = _pairs(text, lo, hi) if _paired.search(text, lo, hi) else {}
    opened_at = set(pairs.values())
    cuts: list[_Cut] = []
    for m in _stops.finditer(text, lo, hi):
        end = m.end()
        # closing quotation marks and brackets, and what stops after them
        while end < hi:
            c = text[end]
            if end in pairs or c in "”»」』)）]】》" and end not in opened_at:
                end += 1
            elif c in ".!?…。।॥۔؟" and end > m.end():
                end += 1
            elif c.isspace() and c != "\n" and end + 1 < hi and (end + 1 in pairs and text[end + 1] in "»”」』)）"):
                end += 2
            else:
                break
        start = end
        while start < hi and text[start].isspace():
            start += 1
        if start >= hi:
            break
        if cuts and start <= cuts[-1].start:
            continue
        # a point within a number, a name or an address ends nothing
        if end == start and m.group() == "." and (text[start].islower() or text[start].isdigit()):
            continue
        opening = _opening(text, start, hi)
        quoted = next((pairs[p] for p in range(end - 1, m.end() - 1, -1) if p in pairs), None) if end > m.end() else None
        fit = _spelling(text, lo, hi, m, end, start, opening, quoted)
        # an exclamation or question that nothing speaks against needs no more
        learnt = () if fit == STRONG and end == m.end() else (_features(text, lo, m, opening, quoted), _first_word(text, start, hi))
        cuts.append(_Cut(end, start, AGAINST if fit is None else fit, *learnt))
    if _has_thai.search(text, lo, hi):
        cuts.extend(_Cut(m.start(), m.end(), BREAK) for m in _thai.finditer(text, lo, hi))
        cuts.sort(key=lambda c: c.end)
    if cuts:
        # pairs that are open at each cut; straight marks that don't show by the
        # blanks around them which is which are left to the program
        sure = [(a, b) for b, a in pairs.items() if text[a] != '"' or _facing(text, lo, a, 1) and _facing(text, hi - 1, b, -1)]
        edges = sorted([(a, 1) for a, _ in sure] + [(b, -1) for _, b in sure])
        straight: list[int] = []
        if '"' in text[lo:hi]:
            paired = {p for p, _ in edges}
            straight = [p for m in re.finditer('"', text[lo:hi]) if (p := lo + m.start()) not in paired]
        k = depth = q = 0
        for c in cuts:
            while k < len(edges) and edges[k][0] < c.end:
                depth += edges[k][1]
                k += 1
            while q < len(straight) and straight[q] < c.end:
                q += 1
            c.inside, c.quotes = depth, q
        last = _Cut(hi, hi, 0.0)
        last.quotes = len(straight)
        return [*cuts, last]
    return [_Cut(hi, hi, 0.0)]


def _facing(text: str, edge: int, at: int, step: int) -> bool:
    """Whether a straight mark has text on the side of ``step`` and a blank, a
    mark or the edge of the block on the other."""
    before = text[at - step] if at != edge else " "
    after = text[at + step : at + step + 1] if step > 0 else text[at - 1]
    return not before.isalnum() and after != "" and not after.isspace()


def _bucket(chars: int) -> int:
    """Half octaves of a length."""
    n = chars.bit_length()
    return 2 * n + ((chars >> (n - 2)) & 1 if n > 1 else 0)


#: The bucket from which lengths aren't told apart, and its least length.
LONGEST = _bucket(1024)
FAR = 1024


def _rule_lengths(cjk: bool) -> list[float]:
    """Without a model: sentences of one or two words are rare, and so are very long ones."""
    short, long = (3, 200) if cjk else (9, 500)
    out = []
    for b in range(LONGEST + 1):
        chars = (1 << (b // 2 - 1)) * (1.0 if b % 2 == 0 else 1.5) if b > 1 else 1.0
        out.append(-1.0 * (short - chars) / short if chars < short else -0.002 * (chars - long) if chars > long else 0.0)
    return out


class Model:
    """Log-odds of an end: those of the spelling, the weights of the closing
    features and of the opening word; and how rare lengths are, for scripts
    without spaces apart.

    Closings are fitted from positive and unlabelled places (Elkan and Noto
    2008). A stop before an empty line is known to be an end; of the others it
    is not known which are, only that those that are look like the known ones:
    the chance that a place is known is the language's ``share`` times the
    chance that it is an end. Weights start at 0 and are drawn back to it, so that with few texts
    the spelling decides alone. Openings weigh how much oftener a word stands
    at a sure start than inside sentences.
    """

    def __init__(self):
        self.weights, self.openings = {}, {}
        self.lengths = {cjk: _rule_lengths(cjk) for cjk in (False, True)}

    def odds(self, cut: _Cut) -> float:
        weights = self.weights
        if not weights or not cut.features:
            return cut.rule
        return cut.rule + sum(weights.get(f, 0.0) for f in cut.features) + self.openings.get(cut.opening, 0.0)

    def fit_openings(self, starts: Counter, inside: Counter, weight: float = 10.0) -> Model:
        """Log-odds up to 2, or 1 where words aren't written large to open."""
        base = sum(starts.values()) / max(1, sum(starts.values()) + sum(inside.values()))
        if 0 < base < 1:
            for w in starts.keys() | inside.keys():
                ratio = (starts[w] + weight * base) / (inside[w] + weight * (1 - base)) * (1 - base) / base
                most = 2.0 if w[:1].isupper() else 1.0
                self.openings[w] = min(most, max(-most, math.log(ratio)))
        return self

    def fit(self, names: list[str], slopes: Callable[[np.ndarray], np.ndarray], rounds: int = 200, pull: float = PULL) -> Model:
        """names: the features; slopes: what the places say of given weights."""
        theta, first, second = np.zeros((3, len(names)))
        for t in range(1, rounds + 1):
            step = slopes(theta) - pull * theta
            # Adam
            first, second = 0.9 * first + 0.1 * step, 0.99 * second + 0.01 * step * step
            theta = theta + 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-6)
        self.weights = {n: float(w) for n, w in zip(names, theta) if abs(w) > 0.01}
        return self

    def fit_lengths(self, counts: dict[bool, np.ndarray]) -> Model:
        """How rare a length is beside the commonest."""
        widths = np.array([max(1.0, 2.0 ** (b // 2 - 2)) for b in range(LONGEST + 1)])
        for cjk, n in counts.items():
            if n.sum() >= 200:
                density = (n + 0.5) / widths
                self.lengths[cjk] = np.clip(0.5 * np.log(density / density.max()), -4, 0).tolist()
        return self


RULES = Model()


def _divide(text: str, lo: int, hi: int, model: Model = RULES) -> Iterator[tuple[int, int]]:
    """The division of a block into spans with the greatest sum of scores.

    A span's score has the odds of its last words and of the opening words
    after it, its length, and the balance of its quotations: the program
    carries along whether a straight quotation is open, which the number of
    marks in each span changes, pays for ending a span inside one, and may pay
    to take a mark of the span for a stray one. best[s][j] is over divisions up
    to cut j with state s. Starts further back than FAR differ no more in
    length, so only the best of them is kept, and time is linear.
    """
    cuts = _cuts(text, lo, hi)
    odds = [model.odds(c) for c in cuts[:-1]]
    yield from _best(lo, [c.end for c in cuts], [c.start for c in cuts], [c.inside for c in cuts], [c.quotes for c in cuts], odds, model.lengths[bool(_inner.search(text, lo, hi))])


def _best(lo: int, cut_ends: list[int], cut_starts: list[int], inside: list[int], cut_quotes: list[int], odds: list[float], lengths: list[float]) -> Iterator[tuple[int, int]]:
    """The program of _divide, over the values of a block's cuts; the last cut is the block's end."""
    if len(cut_ends) == 1:
        yield lo, cut_ends[0]
        return
    starts = [lo, *cut_starts[:-1]]
    quotes = [0, *cut_quotes[:-1]]
    none = float("-inf")
    best: tuple[list[float], list[float]] = ([0.0], [none])
    back: list[tuple] = []
    states = (0, 1) if cut_quotes[-1] else (0,)
    near = 0
    far = [(none, 0), (none, 0)]
    for j, end in enumerate(cut_ends):
        while near <= j and end - starts[near] >= FAR:
            for s in states:
                # the state as if no mark had stood before, to be compared later
                t = s ^ (quotes[near] & 1)
                if best[s][near] > far[t][0]:
                    far[t] = (best[s][near], near)
            near += 1
        value, choice = [none, none], [(0, 0), (0, 0)]
        odd = cut_quotes[j] & 1
        for s in states:
            t = s ^ odd
            if far[s][0] + lengths[LONGEST] > value[t]:
                value[t], choice[t] = far[s][0] + lengths[LONGEST], (far[s][1], s ^ (quotes[far[s][1]] & 1))
        for i in range(near, j + 1):
            n = end - starts[i]
            k = n.bit_length()
            length = lengths[min(LONGEST, 2 * k + ((n >> (k - 2)) & 1 if k > 1 else 0))]
            flip = (quotes[i] & 1) ^ odd
            for s in states:
                if (v := best[s][i] + length) > value[s ^ flip]:
                    value[s ^ flip], choice[s ^ flip] = v, (i, s)
        last = j == len(cut_ends) - 1
        here = 0.0 if last else odds[j] - INSIDE * inside[j]
        ends = [value[0] + here, value[1] + here - (STRAY if last else INSIDE)]
        if value[1] - STRAY > value[0]:
            # a mark of the span is a stray one
            ends[0], choice[0] = value[1] - STRAY + here, choice[1]
        best[0].append(ends[0])
        best[1].append(ends[1])
        back.append(tuple(choice))
    j, s = len(cut_ends) - 1, int(best[1][-1] > best[0][-1])
    spans = []
    while j >= 0:
        i, s = back[j][s]
        spans.append((starts[i], cut_ends[j]))
        j = i - 1
    yield from reversed(spans)


def _flat(text: str) -> str:
    """As long as the text; see _narrow."""
    if text.isascii() and "\r" not in text or not _wide.search(text):
        return text
    return text.replace("\r\n", " \n").translate(_narrow)


def _trimmed(flat: str) -> Iterator[tuple[int, int, bool]]:
    """Blocks without the blanks around them."""
    for lo, hi, whole in _blocks(flat):
        while lo < hi and flat[lo].isspace():
            lo += 1
        while hi > lo and flat[hi - 1].isspace():
            hi -= 1
        if lo < hi:
            yield lo, hi, whole


def _read(text: str | None, starts: Counter, inside: Counter) -> tuple[list[tuple[int, int, list[_Cut] | None]], list[tuple[bool, _Cut]]]:
    """A text's blocks with their cuts, None for whole ones, and what it
    teaches: (known, place) of every place where a sentence may end. Words at
    sure starts and inside sentences are added to the counters.

    The ends of blocks are known to be ends, and are looked at as if the next
    block followed on. In scripts that write openings large, only words that
    are written so count inside.
    """
    if not text or text.isspace():
        return [], []
    flat = _flat(text)
    out, found, following = [], [], ""
    for lo, hi, whole in reversed(list(_trimmed(flat))):
        if whole:
            out.append((lo, hi, None))
            continue
        own, n, opening = flat[lo:hi], hi - lo, following
        following = flat[lo : lo + 80]
        if opening:
            spaced = not _inner.search(own[-4:])
            joined = own + " " * spaced + opening
            seen, base = _cuts(joined, 0, len(joined)), 0
            # whether what follows can change how the block is read
            apart = spaced and not _paired.search(opening) and own[0] != "|" and opening[0] not in "!?।॥" and (own[-1].isalnum() or own[-1] in ".!?…。।॥۔؟")
            cuts = _alone(seen, lo, hi) if apart else _cuts(flat, lo, hi)
        else:
            seen = cuts = _cuts(flat, lo, hi)
            base = lo
        out.append((lo, hi, cuts))
        begins = {0}
        for c in seen:
            if c.features and c.end - base <= n and not c.inside and not c.quotes % 2:
                known = c.end - base == n
                if not known or opening:
                    found.append((known, c))
                if c.rule >= STRONG:
                    begins.add(c.start - base)
        if _inner.search(own):
            continue
        sure = begins | {b + k for b in begins for k in (1, 2) if not own[b : b + k].isalnum()}
        for m in _written.finditer(own):
            at = m.start()
            if at in sure:
                starts[m.group()] += 1
            elif not own[at].islower() and not _stops.search(own[max(0, at - 3) : at]):
                inside[m.group()] += 1
    return out[::-1], found


def _alone(seen: list[_Cut], lo: int, hi: int) -> list[_Cut]:
    """The cuts of a block from those of its text with more after it that
    changes none of them."""
    cuts = []
    for c in seen:
        if c.end < hi - lo:
            one = _Cut(c.end + lo, c.start + lo, c.rule, c.features, c.opening)
            one.inside, one.quotes = c.inside, c.quotes
            cuts.append(one)
    last = _Cut(hi, hi, 0.0)
    last.quotes = seen[-1].quotes if cuts else 0
    return [*cuts, last]


def sentences(text: str | None, model: Model = RULES) -> list[tuple[int, int]]:
    """(start, end) of every sentence of a text, in characters.

    Each non-blank character is in exactly one; a null, empty or blank text
    has none.
    """
    if not text or text.isspace():
        return []
    flat, out = _flat(text), []
    for lo, hi, whole in _trimmed(flat):
        if whole:
            out.append((lo, hi))
        else:
            out.extend(_divide(flat, lo, hi, model))
    return out


def _packed(value) -> bytes:
    return zlib.compress(pickle.dumps(value, pickle.HIGHEST_PROTOCOL), 1)


def _unpacked(value: pa.Scalar):
    return pickle.loads(zlib.decompress(value.as_py()))


def _part(keys: pa.Array, groups: list[str], texts: list[str | None]) -> list[bytes]:
    """Texts read once: their kinds of places (log-odds of the spelling,
    features, opening word), what they teach, and their blocks and cuts as
    numbers."""
    kinds: dict[tuple, int] = {}
    taught, starts, inside = Counter(), Counter(), Counter()
    rows, blocks, cuts = [], [], []
    for k, (group, text) in enumerate(zip(groups, texts)):
        read, found = _read(text, starts, inside)
        for known, c in found:
            taught[group, known, kinds.setdefault((c.rule, c.features, c.opening), len(kinds))] += 1
        for lo, hi, own in read:
            rows.append(k)
            blocks.append((lo, hi, 0 if own is None else len(own), own is not None and bool(_inner.search(text, lo, hi))))
            if own is not None:
                cuts.extend((c.end, c.start, c.inside, c.quotes, kinds.setdefault((c.rule, c.features, c.opening), len(kinds))) for c in own)
    numbers = (keys, np.array(rows, np.int32), np.array(blocks, np.int32).reshape(-1, 4), np.array(cuts, np.int32).reshape(-1, 5))
    return [_packed(x) for x in (list(kinds), (taught, starts, inside), numbers)]


def _parts(documents: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(kinds, taught, cuts): all texts, read once and kept in the shared folder."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            first = chars = 0
            for k, t in enumerate(texts):
                chars += len(t or "")
                if chars >= PART_CHARS or k == len(texts) - 1:
                    part = _part(batch.column(0).slice(first, k + 1 - first), groups[first : k + 1], texts[first : k + 1])
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in part], names=["kinds", "taught", "cuts"])
                    first, chars = k + 1, 0

    return kept(documents.select(F.col(key), language(lang).alias("_g"), F.col(text).alias("_t")).mapInArrow(work, "kinds binary, taught binary, cuts binary"))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, feature, n, m) of each part: how often a feature occurs; or a
    word at sure starts, and inside sentences."""
    for batch in batches:
        for kinds, taught in zip(*batch.columns):
            kinds, (places, starts, inside) = _unpacked(kinds), _unpacked(taught)
            seen: Counter = Counter()
            for (_, _, k), n in places.items():
                for f in kinds[k][1]:
                    seen[f] += n
            words = starts.keys() | inside.keys()
            yield pa.RecordBatch.from_arrays(
                [pa.array([*seen, *words], pa.string()), pa.array([True] * len(seen) + [False] * len(words)), pa.array([*seen.values(), *(starts[w] for w in words)], pa.int64()), pa.array([0] * len(seen) + [inside[w] for w in words], pa.int64())],
                names=["name", "feature", "n", "m"],
            )


def _slopes(columns: tuple[np.ndarray, ...], theta: np.ndarray) -> np.ndarray:
    """The sums of the places' slopes for each feature: multiples of GRAIN."""
    known, rule, n, share, row, col = columns
    g = 1 / (1 + np.exp(-np.clip(rule + np.bincount(row, theta[col], len(rule)), -30, 30)))
    slope = np.where(known, 1 - g, -share * g * (1 - g) / (1 - share * g))
    return np.bincount(col, np.rint(slope * n / GRAIN)[row], len(theta)) * GRAIN


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    known, rule, opened, n, share = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("known", "rule", "opened", "n", "share"))
    features = batch.column("features")
    sizes = np.diff(features.offsets.to_numpy())
    return known, rule + opened, n, share, np.repeat(np.arange(len(sizes)), sizes), features.flatten().to_numpy(zero_copy_only=False)


def _fit(parts: DataFrame, rounds: int = 200) -> Model:
    spark = parts.sparkSession
    counted = parts.select("kinds", "taught").mapInArrow(_words, "name string, feature boolean, n long, m long").groupBy("name", "feature").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    rows = counted.where("not feature or n >= 3").toArrow().to_pydict()
    starts, inside, names = Counter(), Counter(), []
    for name, feature, n, m in zip(*(rows[c] for c in ("name", "feature", "n", "m"))):
        if feature:
            names.append(name)
        else:
            starts[name], inside[name] = n, m
    names.sort()
    model = Model().fit_openings(+starts, +inside)
    told = spark.sparkContext.broadcast(({f: i for i, f in enumerate(names)}, model.openings))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, openings = told.value
        for batch in batches:
            for kinds, taught in zip(*batch.columns):
                kinds, (found, _, _) = _unpacked(kinds), _unpacked(taught)
                sums: Counter = Counter()
                for (group, known, k), n in found.items():
                    rule, features, opening = kinds[k]
                    sums[group, known, rule, openings.get(opening, 0.0), tuple(number[f] for f in features if f in number)] += n
                types = (pa.string(), pa.bool_(), pa.float64(), pa.float64(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(pa.array([p[k] for p in sums], kind) for k, kind in enumerate(types)), pa.array(list(sums.values()), pa.int64())], names=["g", "known", "rule", "opened", "features", "n"])

    schema = "g string, known boolean, rule double, opened double, features array<int>, n long"
    found = kept(parts.select("kinds", "taught").mapInArrow(places, schema).groupBy("g", "known", "rule", "opened", "features").agg(F.sum("n").alias("n")))
    # the share is one of the language, as its blocks' lengths are
    sure = F.col("rule") >= STOP
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    groups = found.groupBy("g").agg(F.count(F.lit(1)).alias("kinds"), total(F.lit(True)).alias("all"), total(F.col("known")).alias("known"), total(sure).alias("sure"), total(sure & F.col("known")).alias("both")).collect()
    sums = {c: sum(r[c] for r in groups) for c in ("kinds", "all", "known", "sure", "both")}
    if sums["known"]:
        mean = sums["both"] / sums["sure"] if sums["sure"] else sums["known"] / sums["all"]
        shares = {r["g"]: min(0.95, max(0.02, (r["both"] + 20 * mean) / (r["sure"] + 20))) for r in groups}
        told_share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
        model.fit(names, _summed(found.withColumn("share", told_share[F.col("g")]).drop("g"), sums["kinds"]), rounds)
    shared = spark.sparkContext.broadcast(model)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kinds, cuts in zip(*batch.columns):
                each = _lengths(_unpacked(kinds), _unpacked(cuts), shared.value)
                yield pa.RecordBatch.from_arrays([pa.array([n.tolist()], pa.list_(pa.int64())) for n in each], names=["spaced", "inner"])

    bucket = parts.select("kinds", "cuts").mapInArrow(lengths, "spaced array<long>, inner array<long>").select(F.posexplode(F.arrays_zip("spaced", "inner")).alias("b", "n"))
    counts = {cjk: np.zeros(LONGEST + 1, np.int64) for cjk in (False, True)}
    for r in bucket.groupBy("b").agg(F.sum("n.spaced").alias("spaced"), F.sum("n.inner").alias("inner")).collect():
        counts[False][r["b"]], counts[True][r["b"]] = r["spaced"], r["inner"]
    return model.fit_lengths(counts)


def _summed(found: DataFrame, kinds: int) -> Callable[[np.ndarray], np.ndarray]:
    """The sums of slopes as a function of the weights: on the driver up to
    LOCAL_PLACES kinds of places, else a job."""
    if kinds <= LOCAL_PLACES:
        own = _columns(found.toArrow().combine_chunks().to_batches()[0])
        return lambda theta: _slopes(own, theta)

    def jobs(theta: np.ndarray) -> np.ndarray:
        shared = found.sparkSession.sparkContext.broadcast(theta)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(len(shared.value))
            for batch in batches:
                out += _slopes(_columns(batch), shared.value)
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(out[at], pa.float64())], names=["f", "slope"])

        rows = found.mapInArrow(work, "f int, slope double").groupBy("f").agg(F.sum("slope").alias("slope")).toArrow()
        shared.destroy()
        out = np.zeros(len(theta))
        out[rows["f"].to_numpy()] = rows["slope"].to_numpy()
        return out

    return jobs


def _odds(kinds: list[tuple[float, tuple[str, ...], str]], model: Model) -> np.ndarray:
    return np.array([model.odds(_Cut(0, 0, *kind)) for kind in kinds], float)


def _lengths(kinds: list[tuple], numbers: tuple, model: Model) -> list[np.ndarray]:
    """Sentences by bucket of length, of scripts with spaces and without, as
    the weights alone divide a part's texts."""
    _, _, blocks, cuts = numbers
    blocks = blocks[blocks[:, 2] > 0]
    if not len(blocks):
        return [np.zeros(LONGEST + 1, np.int64)] * 2
    sizes = blocks[:, 2]
    last = np.zeros(len(cuts), bool)
    last[np.cumsum(sizes) - 1] = True
    ends, starts, inside, quotes, kind = cuts.T
    ending = last | (inside == 0) & (quotes % 2 == 0) & (_odds(kinds, model)[kind] > 0)
    block = np.repeat(np.arange(len(blocks)), sizes)[ending]
    begin = np.roll(starts[ending], 1)
    fresh = np.append(True, block[1:] != block[:-1])
    begin[fresh] = blocks[block[fresh], 0]
    chars = ends[ending] - begin
    # half octaves, as in _bucket
    bits = np.frexp(chars)[1]
    bucket = np.minimum(LONGEST, 2 * bits + np.where(bits > 1, chars >> np.maximum(bits - 2, 0) & 1, 0))
    inner = blocks[block, 3] == 1
    return [np.bincount(bucket[inner == cjk], minlength=LONGEST + 1) for cjk in (False, True)]


def fit(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model fitted on all documents.

    Texts are read once on the executors; equal kinds of places are counted
    there. The driver gets the words and features with their counts, the kinds
    of places only while they are few. Features seen less than three times are
    left out. No documents give the rules.
    """
    return _fit(_parts(documents, key, text, lang))


def fit_split(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """What split gives with the model that fit finds in the same documents;
    their texts are read once for both."""
    parts = _parts(documents, key, text, lang)
    shared = documents.sparkSession.sparkContext.broadcast(_fit(parts))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            for kinds, cuts in zip(*batch.columns):
                odds = _odds(_unpacked(kinds), model)
                keys, of, blocks, cuts = _unpacked(cuts)
                ends, starts, inside, quotes, kind = (c.tolist() for c in cuts.T)
                odds = odds[cuts[:, 4]].tolist()
                rows, found, at = [], [], 0
                for k, (lo, hi, n, inner) in zip(of.tolist(), blocks.tolist()):
                    if n < 2:
                        spans = [(lo, hi)]
                    else:
                        own = slice(at, at + n)
                        spans = list(_best(lo, ends[own], starts[own], inside[own], quotes[own], odds[own], model.lengths[bool(inner)]))
                    at += n
                    rows.extend([k] * len(spans))
                    found.extend(spans)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int64())), *(pa.array([s[k] for s in found], pa.int32()) for k in (0, 1))], names=["k", "start_pos", "end_pos"])

    kind = documents.select(key).schema[0].dataType.simpleString()
    return parts.select("kinds", "cuts").mapInArrow(work, f"k {kind}, start_pos int, end_pos int").select(F.col("k").alias(key), "start_pos", "end_pos")


def split(documents: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(key, start_pos, end_pos), one row per sentence; end_pos is exclusive.

    Repeated rows and equal texts each give their sentences. Without a model
    the rules of spelling decide. No shuffle, and a long text takes time in
    proportion to its length.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model or RULES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, ends = [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                found = sentences(t, shared.value)
                rows.extend([k] * len(found))
                starts.extend(s for s, _ in found)
                ends.extend(e for _, e in found)
            keys = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["k", "start_pos", "end_pos"])

    kind = documents.select(key).schema[0].dataType.simpleString()
    return documents.select(key, text).mapInArrow(work, f"k {kind}, start_pos int, end_pos int").select(F.col("k").alias(key), "start_pos", "end_pos")

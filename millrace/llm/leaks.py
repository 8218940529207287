"""Evaluation texts inside training texts."""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.joins import is_small, lookup_join

#: Letters of a window in scripts with and without spaces between words, and
#: the step at which items' windows are indexed; texts are probed at each letter.
WIDE, NARROW = 12, 6
WIDE_STEP, NARROW_STEP = 4, 2
#: Items of a window from which it counts as common.
COMMON = 3
#: Hits that a passage must have for common windows to be left out.
ENOUGH = 4
#: Share of an item's words that a leak holds, and of words replaced in it.
HELD, REPLACED = 0.5, 0.1
#: Letters by which two pieces of one passage may lie apart.
APART = 40
#: Bytes of item texts in one broadcast block. Its index has 12 bytes for every
#: fourth letter of them, and 64 MB at most for the table before it.
BLOCK_BYTES = 96 << 20
#: Letters of a text that are probed at once.
PROBED = 1 << 20

UNSPACED = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_unspaced = re.compile(f"[{UNSPACED}]")
_code = re.compile(r"""\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|\\[nrtbfv"'/\\]|%[0-9A-F]{2}|&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});|</?[A-Za-z][^<>]{0,200}>""")
_coded = re.compile(r"[\\&<%]")
_other = re.compile(r"[\W_]+")


def _decode(match: re.Match) -> str:
    s = match.group()
    if s[0] == "<":
        return ""
    if s[0] == "&":
        return html.unescape(s)
    if s[0] == "%":
        return " " if int(s[1:], 16) < 128 and not chr(int(s[1:], 16)).isalnum() else s
    return chr(int(s[2:], 16)) if s[1] in "ux" else " "


def letters(text: str) -> str:
    """The letters and digits of a text in one form: without case, accents,
    width, spacing, punctuation, markup and escapes."""
    if _coded.search(text):
        text = _code.sub(_decode, text)
    if text.isascii():
        return _other.sub("", text.lower())
    return _other.sub("", unicodedata.normalize("NFKD", text).casefold())


def letters_at(text: str) -> tuple[str, list[int]]:
    """letters(text) and the place of each in the text."""
    out, at, end = [], [], 0

    def add(piece: str, start: int, step: int) -> None:
        for i, c in enumerate(piece):
            if c.isascii():
                if c.isalnum():
                    out.append(c.lower())
                    at.append(start + i * step)
                continue
            for x in _other.sub("", unicodedata.normalize("NFKD", c).casefold()):
                out.append(x)
                at.append(start + i * step)

    for m in _code.finditer(text):
        add(text[end : m.start()], end, 1)
        add(_decode(m), m.start(), 0)
        end = m.end()
    add(text[end:], end, 1)
    return "".join(out), at


class Item:
    """One evaluation item, as the verification needs it."""

    def __init__(self, item_id: int, text: str | None, canary: str | None):
        self.id = item_id
        words = [w for w in map(letters, (text or "").split()) if w]
        self.text = "".join(words)
        self.unspaced = len(_unspaced.findall(self.text)) > 0.3 * len(self.text)
        if self.unspaced:
            words = list(self.text)
        self.words = len(words)
        self.starts = [0]
        for w in words:
            self.starts.append(self.starts[-1] + len(w))
        self.replaced = 0.15 if self.unspaced else REPLACED
        # the fewest letters that the kept words of a passage can have
        kept = max(0, int(HELD * self.words * (1 - self.replaced) - 0.5))
        self.least = sum(sorted(map(len, words))[:kept])
        self.width = NARROW if self.unspaced else WIDE
        self.step = NARROW_STEP if self.unspaced else WIDE_STEP
        self._pieces: dict[str, list[int]] | None = None
        self.written = mark = letters(canary or "")
        self.canary = re.compile(r"(?<![^\W_])" + r"[\W_]*".join(map(re.escape, mark)) + r"(?![^\W_])") if mark else None

    def pieces(self) -> tuple[int, dict[str, list[int]]]:
        """Where each short piece of the text stands."""
        size = 3 if self.unspaced else 7
        if self._pieces is None:
            self._pieces = defaultdict(list)
            for p in range(len(self.text) - size + 1):
                self._pieces[self.text[p : p + size]].append(p)
        return size, self._pieces

    def windows(self) -> np.ndarray:
        """Hashes of all windows of the text, in order."""
        return hashes(self.text)[0 if self.unspaced else 1]

    def mark(self) -> tuple[bool, int] | None:
        """Whether a wide window ends the canary, and the hash of the window
        that does; None if the canary is too short for one."""
        narrow, wide = hashes(self.written)
        return (True, int(wide[-1])) if len(wide) else (False, int(narrow[-1])) if len(narrow) else None

    def most_gone(self) -> int:
        """Words that a passage can have replaced, at most."""
        return int(self.replaced * self.words + 0.5)

    def indexed(self, common: np.ndarray) -> tuple[int, np.ndarray]:
        """The number of indexed windows that a passage must hit, and the places of these.

        Windows that many items share, such as those of lead-in lines, tell
        little and are left out if the others are enough. Of the windows in a
        stretch with half of the words, each replaced word destroys those that
        it touches: what is left if it is the worst words that are replaced, in
        the stretch that keeps the fewest, is hit by every passage. No more is
        asked for than that.
        """
        every = np.zeros(len(common), bool)
        every[:: self.step] = True
        need = 1
        for chosen in (every & ~common, every):
            need = self._sure(chosen)
            if need >= ENOUGH:
                break
        return max(1, need), np.flatnonzero(chosen)

    def _sure(self, chosen: np.ndarray) -> int:
        """The fewest of the chosen windows that a passage of half the words can have."""
        size, n = len(chosen), -int(-HELD * self.words // 1)
        if not size or not n:
            return 0
        total = np.concatenate([[0], np.cumsum(chosen)])
        starts = np.array(self.starts)
        begin, end = np.minimum(starts[:-1], size), np.minimum(starts[1:], size)
        touched = total[end] - total[np.clip(starts[:-1] - self.width + 1, 0, size)]
        gone = int(self.replaced * n + 0.5)
        least = size
        for i in range(self.words - n + 1):
            inside = total[np.clip(starts[i + n] - self.width + 1, begin[i], size)] - total[begin[i]]
            least = min(least, int(inside) - int(np.sort(touched[i : i + n])[n - gone :].sum()))
        return least


_K = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in (1, 2, 6)]


def hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all narrow and of all wide windows of a text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(codes) < NARROW:
        return np.empty(0, np.uint32), np.empty(0, np.uint32)
    two = codes[:-1] * _K[0] + codes[1:]
    four = two[:-2] * _K[1] + two[2:]
    six = four[:-2] * _K[1] + two[4:]
    twelve = six[:-6] * _K[2] + six[6:]
    return _top(six), _top(twelve)


def _top(h: np.ndarray) -> np.ndarray:
    return (((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32)


_NONE = (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32))


class _Table:
    """Sorted hashes with the number of their item and their place in it,
    behind a table of bits."""

    def __init__(self, parts: list[tuple[int, np.ndarray, np.ndarray]]):
        hash_ = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, np.uint32)
        place = np.concatenate([p[2] for p in parts]) if parts else np.empty(0, np.int32)
        item = np.repeat(np.array([p[0] for p in parts], np.int32), [len(p[1]) for p in parts])
        order = np.argsort(hash_, kind="stable")
        self.hash, self.item, self.place = hash_[order].astype(np.uint32), item[order], place[order].astype(np.int32)
        width = min(26, max(12, int(len(hash_)).bit_length() + 3))
        self.shift = np.uint32(32 - width)
        self.there = np.zeros(1 << width, bool)
        self.there[self.hash >> self.shift] = True

    def hits(self, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the probe, item and place in the item of all that are there."""
        at = np.flatnonzero(self.there[probes >> self.shift]) if len(self.hash) else _NONE[0]
        if not len(at):
            return _NONE
        wanted = probes[at]
        low = np.searchsorted(self.hash, wanted, "left")
        many = np.searchsorted(self.hash, wanted, "right") - low
        at, low, many = at[many > 0], low[many > 0], many[many > 0]
        rows = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.repeat(at, many), self.item[rows], self.place[rows]


class Probe:
    """The hash sets of the items' windows and canaries, as arrays: what every
    text is probed with. Nothing of the items' texts is in it.

    entries: item id, windows needed, whether it is of a script without
    spaces, indexed windows, their places, width and hash of the window
    that ends the canary, and how many words of the item can be replaced at most.
    """

    def __init__(self, entries: list[tuple[int, int, bool, np.ndarray, np.ndarray, tuple[bool, int] | None, int]]):
        self.ids, self.need = [e[0] for e in entries], np.array([e[1] for e in entries], np.int64)
        self.shift = np.array([APART * (e[6] + 1) for e in entries], np.int64)
        numbered = list(enumerate(entries))
        self.wide, self.narrow = (_Table([(i, e[3], e[4]) for i, e in numbered if e[2] == kind and len(e[3])]) for kind in (False, True))
        self.narrow_marks, self.wide_marks = (_Table([(i, np.array([e[5][1]], np.uint32), np.zeros(1, np.int32)) for i, e in numbered if e[5] and e[5][0] == kind]) for kind in (False, True))

    def candidates(self, flat: str) -> dict[int, tuple[list[int], bool]]:
        """item id -> places of the probes that hit, for items with enough of
        them, and whether the end of its canary is there."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        marked: set[int] = set()
        for begin in range(0, max(1, len(flat)), PROBED):
            part = flat[begin : begin + PROBED + WIDE - 1]
            narrow, wide = hashes(part)
            tables = [(self.wide, wide)]
            if len(self.narrow.hash) and _unspaced.search(part):
                tables.append((self.narrow, narrow[:PROBED]))
            for table, probes in tables:
                at, item, place = table.hits(probes)
                if len(at):
                    found.append((item, at + begin, place))
            for table, probes in ((self.narrow_marks, narrow[:PROBED]), (self.wide_marks, wide)):
                if len(table.hash):
                    marked.update(table.hits(probes)[1].tolist())
        out: dict[int, tuple[list[int], bool]] = {}
        if found:
            item, at, place = (np.concatenate(c) for c in zip(*found))
            number, count = np.unique(item, return_counts=True)
            for i in number[count >= self.need[number]]:
                own = item == i
                if hits := _aligned(at[own], place[own], int(self.need[i]), int(self.shift[i])):
                    out[self.ids[i]] = (hits, int(i) in marked)
        return out | {self.ids[i]: ([], True) for i in marked if self.ids[i] not in out}


def _aligned(at: np.ndarray, place: np.ndarray, need: int, shift: int) -> list[int]:
    """Places in the text of the hits that lie with enough others as they lie
    in the item, to within ``shift`` letters by which replaced words can move them."""
    off = at - place
    order = np.argsort(off, kind="stable")
    off, where, what = off[order], at[order], place[order]
    kept = np.zeros(len(off), bool)
    ends = np.searchsorted(off, off + shift, "right")
    for b, e in zip(range(len(off)), ends.tolist()):
        if e - b >= need and not kept[b:e].all() and len(np.unique(what[b:e])) >= need:
            kept[b:e] = True
    return np.sort(where[kept]).tolist()


class Index:
    """Probe and items of a few rows together, on one machine."""

    def __init__(self, rows: list[tuple]):
        self.items = {r[0]: Item(*r) for r in rows}
        windows = {i.id: i.windows() for i in self.items.values()}
        shared = Counter(h for w in windows.values() for h in set(w.tolist()))
        self.needs, entries = {}, []
        for i in self.items.values():
            need, places = i.indexed(np.array([shared[h] >= COMMON for h in windows[i.id].tolist()], bool))
            self.needs[i.id] = need
            entries.append((i.id, need, i.unspaced, windows[i.id][places], places, i.mark(), i.most_gone()))
        self.probe = Probe(entries)


def passage(item: Item, text: str, hits: list[int], need: int, begins: Callable[[int], bool]) -> tuple[int, int, int] | None:
    """The longest stretch of the item that the text holds around the hits, if
    it has half of the item's words: (words, start, end) in the text's letters.

    Equal pieces of item and text are chained in the order of both, with a few
    letters at most between two of them. Words too short for a piece that stand
    unchanged between two pieces, or in their place beyond the outer ones, join
    the chain; in it the longest run of item words is taken of which no more
    than one in ten isn't there unchanged. ``begins`` tells whether a word
    begins at a letter of the text.
    """
    size, where = item.pieces()
    best = None
    for lo, hi in _regions(hits, len(item.text), need):
        lo, hi = max(0, lo), min(len(text), hi)
        blocks, reached = [], {}
        for a in range(lo, hi - size + 1):
            for b in where.get(text[a : a + size], ()):
                if reached.get(a - b, -1) > a:
                    continue
                n = size
                while a + n < hi and b + n < len(item.text) and text[a + n] == item.text[b + n]:
                    n += 1
                reached[a - b] = a + n
                blocks.append((a, b, n))
        chains = _chain(blocks)
        found = _best_run(item, chains)
        if found is None or found[0] < item.words:
            # the windows that every passage hits cover so many letters of its chain
            enough = item.width + item.step * (need - 1)
            found = _best_run(item, [_filled(item, text, c, begins) for c in chains if sum(n for _, _, n in c) >= enough])
        if found and (best is None or found[0] > best[0]):
            best = found
    return best


def _regions(hits: list[int], reach: int, need: int) -> list[tuple[int, int]]:
    """Stretches as long as the item around enough hits for a passage, with
    room on both sides; those that touch are one."""
    hits, out, i = sorted(hits), [], 0
    room = reach // 2 + 4 * APART
    for j, h in enumerate(hits):
        while h - hits[i] > reach + 4 * APART:
            i += 1
        if j - i + 1 >= need:
            if out and hits[i] - room <= out[-1][1]:
                out[-1][1] = h + room
            else:
                out.append([hits[i] - room, h + room])
    return [tuple(x) for x in out]


def _chain(blocks: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Chains of blocks, each with the most letters that end in its last."""
    blocks.sort()
    score, before = [], []
    reach = APART + max((n for _, _, n in blocks), default=0)
    for j, (a, b, n) in enumerate(blocks):
        top, prev = n, -1
        for i in range(j - 1, -1, -1):
            x, y, m = blocks[i]
            if a - x > reach:
                break
            over = max(x + m - a, y + m - b, 0)
            if over >= min(n, m) or x >= a or y >= b or a - x - m > APART or b - y - m > APART:
                continue
            # a shift between text and item costs a little
            if (s := score[i] + n - over - min(4, abs((a - x) - (b - y)))) > top:
                top, prev = s, i
        score.append(top)
        before.append(prev)
    chains, used = [], set()
    for j in sorted(range(len(blocks)), key=lambda k: -score[k]):
        if j in used:
            continue
        chain, k = [], j
        while k >= 0 and k not in used:
            used.add(k)
            chain.append(blocks[k])
            k = before[k]
        chains.append(chain[::-1])
    return chains


def _filled(item: Item, text: str, chain: list[tuple[int, int, int]], begins: Callable[[int], bool]) -> list[tuple[int, int, int]]:
    """A chain with the unchanged words of the item in its gaps and at its ends."""
    spaced = not item.unspaced
    if not spaced:
        begins = lambda k: True
    starts, out = item.starts, list(chain)
    for (a, b, n), (c, d, _) in zip(chain, chain[1:]):
        # ends[k]: the least end of k words found in order, and these words
        ends: list[tuple[int, list[tuple[int, int, int]]]] = [(a + n, [])]
        for i in range(bisect_left(starts, b + n), bisect_right(starts, d) - 1):
            s, w = starts[i], item.text[starts[i] : starts[i + 1]]
            for k in range(len(ends) - 1, -1, -1):
                p = text.find(w, ends[k][0], c)
                while p >= 0 and p - s not in (a - b, c - d) and not (spaced and begins(p) and begins(p + len(w))):
                    p = text.find(w, p + 1, c)
                if p >= 0 and (k + 1 == len(ends) or p + len(w) < ends[k + 1][0]):
                    ends[k + 1 : k + 2] = [(p + len(w), [*ends[k][1], (p, s, len(w))])]
        out.extend(ends[-1][1])
    # beyond the ends word stands against word; no run can have more gone
    most = item.replaced * item.words + 1
    a, b, _ = chain[0]
    i, gone = bisect_left(starts, b) - 1, 0
    # a word of the text that is there in part stands against the item's word
    inside = None if begins(a) else _beside(a, -1, len(text), begins)
    if starts[i + 1] > b:
        i, gone, a = i - 1, 1, a if begins(a) else a - b + starts[i]
    a = a if inside is None else inside
    while i >= 0 and a > 0 and gone <= most:
        n = starts[i + 1] - starts[i]
        if a >= n and text.startswith(item.text[starts[i] : starts[i + 1]], a - n) and begins(a - n):
            a -= n
            out.append((a, starts[i], n))
        else:
            gone += 1
            a = _beside(a, -1, len(text), begins) or a - n
        i -= 1
    a, b, n = chain[-1]
    a, b = a + n, b + n
    i, gone = bisect_left(starts, b), 0
    inside = None if begins(a) else _beside(a, 1, len(text), begins)
    if starts[i] > b:
        gone, a = 1, a if begins(a) else a + starts[i] - b
    a = a if inside is None else inside
    while i < item.words and a < len(text) and gone <= most:
        n = starts[i + 1] - starts[i]
        if text.startswith(item.text[starts[i] : starts[i + 1]], a) and begins(a + n):
            out.append((a, starts[i], n))
            a += n
        else:
            gone += 1
            a = _beside(a, 1, len(text), begins) or a + n
        i += 1
    return sorted(out)


def _beside(at: int, step: int, n: int, begins: Callable[[int], bool]) -> int | None:
    """The nearest place before or after ``at`` where a word begins."""
    return next((k for k in range(at + step, at + step * (APART + 1), step) if 0 < k < n and begins(k)), None)


def _best_run(item: Item, chains: list) -> tuple[int, int, int] | None:
    best, half = None, HELD * item.words
    for chain in chains:
        if sum(n for _, _, n in chain) < item.least:
            continue
        there = [False] * len(item.text)
        for _, b, n in chain:
            there[b : b + n] = [True] * n
        kept = [all(there[s:e]) for s, e in zip(item.starts, item.starts[1:])]
        # a run with r of its words gone may be so long: r <= a tenth of it, rounded
        share = item.replaced
        gone = [0]
        for k in kept:
            gone.append(gone[-1] + (not k))
        low = [(gone[i] - share * i) for i in range(len(gone))]
        # longest i < j with low[j] - low[i] <= 0.5 and kept words at both ends
        starts, tops = [], []
        for i in range(item.words):
            if kept[i] and (not tops or low[i] > tops[-1]):
                starts.append(i)
                tops.append(low[i])
        for j in range(item.words, 0, -1):
            if best and j <= best[0]:
                break
            if not kept[j - 1]:
                continue
            k = next((i for i, t in zip(starts, tops) if t >= low[j] - 0.5), None)
            if k is not None and k < j and j - k >= half and (best is None or j - k > best[0]):
                first, last = item.starts[k], item.starts[j] - 1
                begin = next(a + first - b for a, b, n in chain if b <= first < b + n)
                end = next(a + last - b for a, b, n in chain if b <= last < b + n) + 1
                best = (j - k, begin, end)
    return best


def _unique(items: DataFrame) -> DataFrame:
    """One row per item; of rows with the same id the greatest counts."""
    kept = items.where(F.col("item_id").isNotNull()).groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.max(F.struct("text", "canary")).alias("r"))
    return kept.select("item_id", "r.text", "r.canary")


def _entries(items: DataFrame) -> DataFrame:
    """What Probe takes of every item, and the bytes of its text.

    Common windows are counted over all items: a row per window is shuffled by
    its hash and, if common, once more by item.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Item(*r).windows().tolist() for r in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["item_id", "windows"])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item_id, text, canary, places in zip(*(c.to_pylist() for c in batch.columns)):
                item = Item(item_id, text, canary)
                common = np.zeros(max(0, len(item.text) - item.width + 1), bool)
                common[places or []] = True
                need, at = item.indexed(common)
                out.append((item_id, need, item.unspaced, item.windows()[at].tolist(), at.tolist(), item.mark() and list(map(int, item.mark())), item.most_gone(), len((text or "").encode("utf-8", "replace"))))
            kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["item_id", "need", "unspaced", "windows", "at", "mark", "gone", "bytes"])

    all_windows = items.mapInArrow(windows, "item_id long, windows array<long>")
    common = all_windows.select(F.explode(F.array_distinct("windows")).alias("h")).groupBy("h").count().where(F.col("count") >= COMMON).select("h")
    places = all_windows.select("item_id", F.posexplode("windows").alias("place", "h")).join(common, "h").groupBy("item_id").agg(F.collect_list("place").alias("places"))
    named = items.join(places, "item_id", "left").select("item_id", "text", "canary", "places")
    return named.mapInArrow(entries, "item_id long, need int, unspaced boolean, windows array<long>, at array<int>, mark array<long>, gone int, bytes long")


def _probes(items: DataFrame) -> Iterator[Probe]:
    """Probes of the items in blocks whose bytes are bounded."""
    rows, size = [], 0
    entries = _entries(items)
    # one job if all fit in one block, otherwise a partition at a time
    for r in entries.collect() if is_small(items, BLOCK_BYTES) else entries.toLocalIterator():
        if rows and size + r["bytes"] > BLOCK_BYTES:
            yield Probe(rows)
            rows, size = [], 0
        rows.append((r["item_id"], r["need"], r["unspaced"], np.array(r["windows"], np.uint32), np.array(r["at"], np.int32), (bool(r["mark"][0]), r["mark"][1]) if r["mark"] else None, r["gone"]))
        size += r["bytes"]
    if rows:
        yield Probe(rows)


LEAKS = "doc_id long, item_id long, kind string, words int, item_words int, start_pos int, end_pos int"
CANDIDATES = "doc_id long, text string, item_id long, need int, hits array<int>, marked boolean"


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Which document holds which item, and where.

    kind is ``canary`` (the whole canary stands in the text) or ``passage``
    (words of item_words are there in order, together, at most a tenth of
    them replaced). One row per document, item and kind; start_pos and end_pos
    are places in the text. A null or empty text, or an item without text and
    canary, has no row; equal texts each have theirs. Canaries of fewer letters
    than a narrow window aren't looked for.

    The texts are read once for every 96 MB of items and stay where they are:
    what is broadcast are hashes of the items' windows. The few texts with
    enough hits go on, with the items they point to, to be verified: a join on
    the item, whose texts are broadcast only if they are small.
    """
    spark = documents.sparkSession
    items = _unique(items)
    near = None
    for probe in _probes(items):
        shared = spark.sparkContext.broadcast(probe)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            probe: Probe = shared.value
            need = dict(zip(probe.ids, probe.need.tolist()))
            names = [f.split()[0] for f in CANDIDATES.split(", ")]
            types = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.bool_()]
            for batch in batches:
                found = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if text:
                        found.extend((doc, text, item, need[item], hits, marked) for item, (hits, marked) in probe.candidates(letters(text)).items())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(types)], names=names)

        part = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, CANDIDATES)
        near = part if near is None else near.unionByName(part)
    if near is None:
        return spark.createDataFrame([], LEAKS)
    both = lookup_join(near, items.select("item_id", F.col("text").alias("item_text"), "canary"), ["item_id"], "inner")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, Item] = {}
        for batch in batches:
            found = []
            for doc, text, item_id, need, hits, marked, item_text, canary in zip(*(c.to_pylist() for c in batch.columns)):
                if item_id not in kept:
                    if len(kept) > 1000:
                        kept.clear()
                    kept[item_id] = Item(item_id, item_text, canary)
                found.extend((doc, item_id, *x) for x in _verified(kept[item_id], text, letters(text), hits, need, marked))
            names = [f.split()[0] for f in LEAKS.split(", ")]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(types)], names=names)

    return both.select("doc_id", "text", "item_id", "need", "hits", "marked", "item_text", "canary").mapInArrow(verify, LEAKS)


def _scan(index: Index, text: str) -> Iterator[tuple]:
    """(item, kind, words, item's words, start, end) of the leaks in one text."""
    flat = letters(text)
    for item, (hits, marked) in index.probe.candidates(flat).items():
        for found in _verified(index.items[item], text, flat, hits, index.needs[item], marked):
            yield item, *found


def _verified(item: Item, text: str, flat: str, hits: list[int], need: int, marked: bool) -> Iterator[tuple]:
    exact = None

    def begins(k: int) -> bool:
        nonlocal exact
        if k <= 0 or k >= len(flat):
            return True
        exact = exact or letters_at(text)[1]
        between = text[exact[k - 1] : exact[k]]
        return any(map(str.isspace, _code.sub(_decode, between) if _coded.search(between) else between))

    if hits and (hit := passage(item, flat, hits, need, begins)):
        exact = exact or letters_at(text)[1]
        yield "passage", hit[0], item.words, exact[hit[1]], exact[hit[2] - 1] + 1
    if marked and item.canary and item.written in flat:
        plain, at = _folded(text)
        if m := item.canary.search(plain):
            yield "canary", None, item.words, at[m.start()], at[m.end() - 1] + 1


def _folded(text: str) -> tuple[str, list[int]]:
    """The text decoded and folded as in letters(), with its other characters."""
    out, at, end = [], [], 0

    def add(piece: str, start: int, step: int) -> None:
        for i, c in enumerate(piece):
            for x in unicodedata.normalize("NFKD", c).casefold():
                out.append(x)
                at.append(start + i * step)

    for m in _code.finditer(text):
        add(text[end : m.start()], end, 1)
        add(_decode(m), m.start(), 0)
        end = m.end()
    add(text[end:], end, 1)
    return "".join(out), at


def trainable(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents whose source is neither held out nor never to be trained on;
    null flags, and sources that aren't listed, count as false."""
    barred = F.coalesce("held_out", F.lit(False)) | F.coalesce("never_train", F.lit(False))
    flags = sources.where(F.col("source_id").isNotNull()).groupBy(F.col("source_id").alias("source")).agg(F.max(barred).alias("_barred"))
    return lookup_join(documents, flags, ["source"]).where(~F.coalesce("_barred", F.lit(False))).drop("_barred")


def leaks(documents: DataFrame, sources: DataFrame, items: DataFrame) -> DataFrame:
    return find_leaks(trainable(documents.select("doc_id", "source", "text"), sources), items)


def without_leaks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Documents with a leak, their passages and canaries cut out.

    (doc_id, text, cut): overlapping places are cut once; a document that is
    nothing else becomes an empty text.
    """
    spans = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos"))).alias("spans"))
    joined = documents.select("doc_id", "text").join(spans, "doc_id")
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"), F.lit(0).alias("cut"))
    walked = F.aggregate(
        "spans",
        start,
        lambda acc, s: F.struct(
            F.concat(acc["text"], F.when(s["start_pos"] > acc["at"], F.substr("text", acc["at"] + 1, s["start_pos"] - acc["at"])).otherwise("")).alias("text"),
            F.greatest(acc["at"], s["end_pos"]).alias("at"),
            (acc["cut"] + F.greatest(F.lit(0), s["end_pos"] - F.greatest(acc["at"], s["start_pos"]))).alias("cut"),
        ),
    )
    return joined.select("doc_id", walked.alias("w"), "text").select("doc_id", F.concat(F.col("w.text"), F.substr("text", F.col("w.at") + 1)).alias("text"), F.col("w.cut").alias("cut"))


def beside_blocks(documents: DataFrame, found: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per shard: leaking documents and leaked items, and the reasons for
    which the shard was ever blocked (empty if it was not). A block record can
    name several shards, apart by commas, semicolons, bars or blanks."""
    per = documents.select("doc_id", "shard_id").join(found, "doc_id").groupBy("shard_id").agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("item_id").alias("items"))
    named = blocks.select(F.explode(F.split(F.trim("shard_id"), r"[,;|\s]+")).alias("shard_id"), "reason").where(F.col("shard_id") != "")
    reasons = named.groupBy("shard_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    return per.join(reasons, "shard_id", "left").withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))

"""Per-document text statistics, and a structural profile that tells prose from lists, tables and junk.

A text is divided into runs of lines of like layout. Each run becomes a few distributions: its classes of
characters, its share of function words, the layout of its lines, how often words come back, and how much
of it lies in endless tokens. The profile with the smallest weighted Jensen-Shannon divergence to these
names the run; tests on single lines are features of it and decide nothing. Profiles start from fixed
values and are fitted, per language for prose and per structure for the rest, on all documents.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.hashing import mix
from notelake.llm.language import LANGUAGES, label_language

#: A document is a case if more than this share of its characters is not prose.
MAINLY = 2 / 3
#: Common words up to this number are sent to the tasks (8 bytes each); more are an error.
MOST_COMMON_WORDS = 1_000_000
#: A profile with fewer runs than this, or than this share of the number of documents, keeps its first values: what few runs are nearest
#: to a rare profile are mostly strays of others. A share, so that a table repeated any number of times gives the same profiles.
LEAST_RUNS, LEAST_SHARE = 20, 0.01
#: Characters looked at together; a longer text is a batch of its own.
HELD_CHARS = 1_000_000
_U = np.uint64

HEADING = re.compile(r"#{1,6}\s")
BULLET = re.compile(r"\s*(?:[-*+•·▪]|\(?\d{1,4}[.)]|\(?[a-zA-Z][.)]|[①-⑳])\s+\S")
LOG = re.compile(r"[\[(<]?(?:\d{4}[-/]\d\d[-/]\d\d|\d\d:\d\d:\d\d|[A-Z][a-z]{2}\s+\d{1,2}\s\d\d:\d\d)")
RULE = re.compile(r"\|?[\s:|-]*-{3,}[\s:|-]*\|?$|([-=_*~+#])\1{2,}\s*$")
GAPS = re.compile(r"(?<=\S)(?: {2,}|\t+)(?=\S)")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
STOPS, CLOSERS = ".!?。！？…", "'\"”’»)]"
COMMAS = ",、，;；،"
THREE_LETTERS_OR_DIGITS = re.compile(r"[^\W_]{3}")
LABEL = re.compile(r"\s*[^\s:：]{1,24}(?: [^\s:：]{1,24})?\s*[:：]\s+\S")
SPEAKER = re.compile(r"\s*[^:：\n]{1,24}[:：]\s+")
WIDE = re.compile("[！-～]{4}")

# Classes of characters and layouts of lines a profile is made of.
CLASSES = ("lower", "upper", "digit", "blank", "stop", "comma", "mark", "hangul", "hiragana", "katakana", "han")
SHAPES = ("stop", "plain", "short", "bullet", "cell", "log", "noise")

# Fixed values, from which the fit starts: name, structure, shares of the classes, share of function words, shares of the layouts,
# share of words that are new, share of characters in endless tokens.
SEEDS = (
    ("prose latin", "prose", {"lower": 0.78, "upper": 0.025, "digit": 0.005, "blank": 0.17, "stop": 0.012, "comma": 0.008}, 0.40, {"stop": 0.8, "plain": 0.15, "short": 0.05}, 1.0, 0.0),
    ("prose hangul", "prose", {"hangul": 0.70, "blank": 0.24, "stop": 0.02, "comma": 0.005, "lower": 0.025, "digit": 0.01}, 0.60, {"stop": 0.8, "plain": 0.15, "short": 0.05}, 1.0, 0.0),
    ("prose kana", "prose", {"hiragana": 0.45, "katakana": 0.05, "han": 0.42, "stop": 0.03, "comma": 0.02, "lower": 0.03}, 0.50, {"stop": 0.8, "plain": 0.15, "short": 0.05}, 1.0, 0.0),
    ("unpunctuated latin", "prose", {"lower": 0.82, "upper": 0.01, "blank": 0.17}, 0.40, {"plain": 1.0}, 1.0, 0.0),
    ("unpunctuated hangul", "prose", {"hangul": 0.74, "blank": 0.25, "lower": 0.01}, 0.60, {"plain": 1.0}, 1.0, 0.0),
    ("unpunctuated kana", "prose", {"hiragana": 0.48, "katakana": 0.05, "han": 0.45, "lower": 0.02}, 0.50, {"plain": 1.0}, 1.0, 0.0),
    ("wrapped latin", "prose", {"lower": 0.80, "upper": 0.02, "blank": 0.17, "stop": 0.01}, 0.40, {"stop": 0.15, "plain": 0.25, "short": 0.60}, 1.0, 0.0),
    ("wrapped hangul", "prose", {"hangul": 0.72, "blank": 0.25, "stop": 0.02, "lower": 0.01}, 0.60, {"stop": 0.15, "plain": 0.15, "short": 0.70}, 1.0, 0.0),
    ("wrapped kana", "prose", {"hiragana": 0.46, "katakana": 0.05, "han": 0.44, "stop": 0.02, "lower": 0.03}, 0.50, {"stop": 0.15, "plain": 0.15, "short": 0.70}, 1.0, 0.0),
    ("bullets latin", "list", {"lower": 0.72, "upper": 0.04, "blank": 0.17, "mark": 0.05, "digit": 0.02}, 0.02, {"bullet": 1.0}, 1.0, 0.0),
    ("bullets hangul", "list", {"hangul": 0.50, "lower": 0.13, "upper": 0.03, "blank": 0.26, "mark": 0.08}, 0.10, {"bullet": 1.0}, 1.0, 0.0),
    ("bullets han", "list", {"han": 0.5, "hiragana": 0.06, "katakana": 0.05, "lower": 0.15, "upper": 0.03, "blank": 0.15, "mark": 0.06}, 0.10, {"bullet": 1.0}, 1.0, 0.0),
    ("short lines latin", "list", {"lower": 0.80, "upper": 0.04, "blank": 0.16}, 0.02, {"short": 1.0}, 1.0, 0.0),
    ("short lines hangul", "list", {"hangul": 0.60, "lower": 0.12, "upper": 0.02, "blank": 0.26}, 0.10, {"short": 1.0}, 1.0, 0.0),
    ("cells latin", "table", {"lower": 0.62, "upper": 0.03, "digit": 0.14, "blank": 0.08, "comma": 0.08, "mark": 0.05}, 0.0, {"cell": 1.0}, 1.0, 0.0),
    ("cells hangul", "table", {"hangul": 0.40, "lower": 0.10, "digit": 0.18, "blank": 0.15, "comma": 0.10, "mark": 0.07}, 0.10, {"cell": 1.0}, 1.0, 0.0),
    ("cells han", "table", {"han": 0.40, "katakana": 0.05, "digit": 0.20, "blank": 0.15, "comma": 0.10, "mark": 0.10}, 0.10, {"cell": 1.0}, 1.0, 0.0),
    ("keywords latin", "junk", {"lower": 0.80, "upper": 0.02, "blank": 0.09, "comma": 0.08, "mark": 0.01}, 0.0, {"plain": 1.0}, 1.0, 0.0),
    ("keywords hangul", "junk", {"hangul": 0.55, "lower": 0.10, "blank": 0.20, "comma": 0.15}, 0.10, {"plain": 1.0}, 1.0, 0.0),
    ("keywords mixed", "junk", {"hangul": 0.25, "lower": 0.50, "blank": 0.13, "comma": 0.12}, 0.04, {"plain": 1.0}, 1.0, 0.0),
    ("keywords han", "junk", {"hiragana": 0.03, "katakana": 0.07, "han": 0.65, "blank": 0.10, "comma": 0.15}, 0.08, {"plain": 1.0}, 1.0, 0.0),
    ("letters", "junk", {"lower": 0.87, "blank": 0.13}, 0.0, {"plain": 1.0}, 1.0, 0.0),
    ("encoded", "junk", {"lower": 0.40, "upper": 0.40, "digit": 0.16, "mark": 0.04}, 0.0, {"plain": 1.0}, 1.0, 1.0),
    ("encoded lines", "junk", {"lower": 0.40, "upper": 0.40, "digit": 0.16, "mark": 0.04}, 0.0, {"short": 1.0}, 1.0, 1.0),
    ("numbers", "junk", {"lower": 0.30, "digit": 0.60, "blank": 0.10}, 0.0, {"plain": 1.0}, 1.0, 0.0),
    ("machine", "junk", {"lower": 0.50, "upper": 0.08, "digit": 0.22, "blank": 0.08, "mark": 0.12}, 0.0, {"log": 1.0}, 1.0, 0.0),
    ("garbled", "junk", {"lower": 0.50, "blank": 0.20, "mark": 0.30}, 0.02, {"plain": 0.8, "stop": 0.2}, 1.0, 0.0),
    ("machine lines", "junk", {"lower": 0.30, "digit": 0.60, "blank": 0.10}, 0.0, {"short": 1.0}, 1.0, 0.0),
    ("symbols", "junk", {"lower": 0.20, "mark": 0.70, "blank": 0.10}, 0.0, {"noise": 1.0}, 1.0, 0.0),
    ("repetition latin", "junk", {"lower": 0.80, "upper": 0.01, "blank": 0.17, "stop": 0.02}, 0.30, {"plain": 0.7, "stop": 0.3}, 0.2, 0.0),
    ("repetition hangul", "junk", {"hangul": 0.75, "blank": 0.23, "stop": 0.02}, 0.50, {"plain": 0.7, "stop": 0.3}, 0.2, 0.0),
    ("repetition kana", "junk", {"hiragana": 0.45, "katakana": 0.05, "han": 0.45, "stop": 0.03}, 0.50, {"plain": 0.7, "stop": 0.3}, 0.2, 0.0),
)
KINDS = ("prose", "list", "table", "junk")
#: Weights of the five distributions: classes, function words, layout, new words, endless tokens.
WEIGHTS = (1.0, 2.0, 1.0, 3.0, 1.0)
PARTS = (len(CLASSES), 2, len(SHAPES), 2, 2)
DIMS = sum(PARTS)

# Last syllables of Korean words that mark case, topic, link or predicate, used where the documents have too little Korean.
KOREAN_ENDINGS = "은는이가을를에의로와과도만고며면서다지"

STOP, COMMA, MARK, DIGIT, BLANK, HANGUL, HIRAGANA, KATAKANA, HAN, LOWER, UPPER = (CLASSES.index(c) for c in ("stop", "comma", "mark", "digit", "blank", "hangul", "hiragana", "katakana", "han", "lower", "upper"))


def _class(char: str) -> int:
    point = ord(char)
    if char in STOPS:
        return STOP
    if char in COMMAS:
        return COMMA
    if char.isspace():
        return BLANK
    if char.isdigit():
        return DIGIT
    if 0xAC00 <= point <= 0xD7A3 or 0x1100 <= point <= 0x11FF:
        return HANGUL
    if 0x3040 <= point <= 0x309F:
        return HIRAGANA
    if 0x30A0 <= point <= 0x30FF:
        return KATAKANA
    if 0x4E00 <= point <= 0x9FFF or 0x3400 <= point <= 0x4DBF:
        return HAN
    if char.isalpha():
        return UPPER if char.isupper() else LOWER
    return MARK


class CharTable:
    """Class, word character and small letter of each code point, looked up for whole arrays; filled as code points are met."""

    def __init__(self):
        self.classes = np.full(0x110000, 255, np.uint8)
        self.small = np.arange(0x110000, dtype=np.uint32)

    def of(self, points: np.ndarray) -> np.ndarray:
        """The class of each code point, plus 16 for letters and digits."""
        out = self.classes[points]
        if len(points) and out.max() == 255:
            for p in np.unique(points[out == 255]).tolist():
                char = chr(p)
                self.classes[p] = _class(char) + 16 * char.isalnum()
                low = char.lower()
                self.small[p] = ord(low) if len(low) == 1 else p
            out = self.classes[points]
        return out


def word_hash(points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of ``points[start : start + size]``."""
    if not len(starts):
        return np.empty(0, _U)
    flat = np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(int(sizes.sum()))
    place = flat - np.repeat(starts, sizes)
    with np.errstate(over="ignore"):
        return np.add.reduceat(mix(points[flat].astype(_U) + (place.astype(_U) << _U(32)) + _U(1)), np.cumsum(sizes) - sizes)


def hash_words(words: frozenset[str]) -> np.ndarray:
    """Sorted hashes of a list of words, as :func:`word_hash` gives them."""
    words = [w for w in words if w]
    if not words:
        return np.empty(0, _U)
    sizes = np.array([len(w) for w in words])
    return np.unique(word_hash(_points("".join(words)), np.cumsum(sizes) - sizes, sizes))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)] == values


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log2(x + x.dtype.type(1e-12))


def divergence(p: np.ndarray, q: np.ndarray, weight: np.ndarray | float = 1.0) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of ``p`` to each row of ``q``; weighted sums of several if ``weight`` says so."""
    p, q = np.atleast_2d(p), np.atleast_2d(q)
    w = np.broadcast_to(np.asarray(weight, p.dtype), (p.shape[1],))
    out = (_xlogx(p) @ w / 2)[:, None] + (_xlogx(q) @ w / 2)[None]
    for k in range(len(q)):
        out[:, k] -= _xlogx((p + q[k]) / 2) @ w
    return out


class Profiles:
    """Rows of five distributions each, with the structure they stand for."""

    def __init__(self, names: list[str], kinds: list[str], rows: np.ndarray, endings: str = KOREAN_ENDINGS):
        self.names, self.kinds, self.rows, self.endings = names, kinds, rows, endings
        self.weight = np.repeat(np.array(WEIGHTS, np.float32), PARTS)

    @classmethod
    def seeds(cls) -> Profiles:
        rows = [[*(d.get(c, 0.0) for c in CLASSES), f, 1 - f, *(s.get(c, 0.0) for c in SHAPES), new, 1 - new, 1 - long, long] for _, _, d, f, s, new, long in SEEDS]
        rows = np.array(rows, np.float32)
        for a, b in zip(np.cumsum((0, *PARTS[:-1])), np.cumsum(PARTS), strict=True):
            rows[:, a:b] /= rows[:, a:b].sum(1, keepdims=True)
        return cls([s[0] for s in SEEDS], [s[1] for s in SEEDS], rows)

    def divergences(self, p: np.ndarray) -> np.ndarray:
        return divergence(p, self.rows, self.weight)


# Layouts of single lines that stand outside the five distributions.
_PLAIN, _BULLET, _CELL, _LOG, _NOISE, _LABEL, _CELLS, _RULE, _NEUTRAL, _EMPTY = range(10)


class Profiler:
    """Measures batches of texts: runs of lines, their distributions and nearest profiles."""

    def __init__(self, words: frozenset[str], profiles: Profiles):
        self.words, self.common, self.profiles, self.table = words, hash_words(words), profiles, CharTable()
        self.prose = np.array([k == "prose" for k in profiles.kinds])
        self.kind_of = np.array([KINDS.index(k) for k in profiles.kinds])
        self.endings = np.unique(_points(profiles.endings)) if profiles.endings else np.empty(0, np.uint32)

    # ---- single lines
    def function_share_of_line(self, text: str) -> float:
        words = WORD.findall(text.lower())
        known, ends = self.words, self.profiles.endings
        return len([w for w in words if w in known or w[-1] in ends and len(w) > 1]) / len(words) if words else 0.0

    def layout(self, flat: str) -> int:
        """The layout of one line without blanks around it."""
        if HEADING.match(flat):
            return _NEUTRAL
        if RULE.match(flat):
            return _RULE
        if flat[0] == flat[-1] == "|" and flat.count("|") >= 3 or flat.count(" | ") >= 2:
            cells = [c for c in flat.strip("|").split("|") if c.strip()]
            if 2 * sum(any(map(str.isalnum, c)) for c in cells) > len(cells):
                return _CELL
        if len(flat) > 2 and not THREE_LETTERS_OR_DIGITS.search(flat) and sum(map(str.isalnum, flat)) < 0.25 * len(flat):
            return _NOISE
        if LOG.match(flat):
            return _LOG
        if BULLET.match(flat):
            return _BULLET
        ended = flat.rstrip(CLOSERS)[-1:] in STOPS
        if "\t" in flat or GAPS.search(flat):
            cells = [c for c in GAPS.split(flat) if c]
            if len(cells) >= 2 and max(len(c.split()) for c in cells) <= 4 and (len(cells) < 5 or self.function_share_of_line(" ".join(cells)) < 0.25):
                return _CELL
        for mark in (",", ";"):
            if flat.count(mark) >= 1 and f"{mark} " not in flat and not ended:
                cells = flat.split(mark)
                if len(cells) >= 2 and max(len(c.split()) for c in cells) <= 4:
                    return _CELLS
        if len(flat) <= 120 and not ended and LABEL.match(flat):
            body = SPEAKER.sub("", flat, count=1)
            words = WORD.findall(body.lower())
            korean = sum("가" <= w[-1] <= "힣" for w in words) * 2 > len(words)
            if len(words) <= 8 and (not any(w[-1] in "다요까" for w in words) if korean else self.function_share_of_line(body) < 0.3):
                return _LABEL
        return _PLAIN

    # ---- batches
    def runs(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Arrays over the runs of all texts: owner, layout, size, counts, distributions; and over the texts: statistics."""
        table, n_texts = self.table, len(texts)
        joined = "\n".join(texts)
        points = _points(joined)
        coded = table.of(points)
        kind, word_char = coded & 15, coded >= 16
        # lines
        feeds = np.flatnonzero(points == 10)
        starts, ends = np.r_[0, feeds + 1], np.r_[feeds, len(points)]
        first_line = np.r_[0, np.cumsum([t.count("\n") + 1 for t in texts])]
        owner = np.repeat(np.arange(n_texts), np.diff(first_line))
        line_of = np.zeros(len(points), np.int64)
        line_of[feeds[feeds + 1 < len(points)] + 1] = 1
        line_of = np.cumsum(line_of)
        n_lines = len(starts)
        counts = np.bincount(line_of * 16 + kind, minlength=n_lines * 16).reshape(n_lines, 16)[:, : len(CLASSES)]
        counts[: n_lines - 1, BLANK] -= 1  # the line feed itself
        shown = np.flatnonzero(kind != BLANK)
        a, b = np.searchsorted(shown, starts), np.searchsorted(shown, ends)
        empty = a == b
        safe = len(shown) - 1 if len(shown) else 0
        begin = shown[np.minimum(a, safe)] if len(shown) else np.zeros(n_lines, np.int64)
        last = shown[np.maximum(np.minimum(b, safe + 1) - 1, 0)] if len(shown) else np.zeros(n_lines, np.int64)
        tail = last.copy()
        for _ in range(3):
            tail = np.where(np.isin(points[tail], _points(CLOSERS)) & (tail > begin), tail - 1, tail)
        stopped = ~empty & (kind[tail] == STOP)
        # words
        inner = (points == 0x27) | (points == 0x2019)
        if len(points) > 2:
            inner[1:-1] &= word_char[:-2] & word_char[2:]
            inner[[0, -1]] = False
        else:
            inner[:] = False
        letters = word_char | inner
        edge = np.diff(np.r_[False, letters, False].astype(np.int8))
        w_start, w_size = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
        small = table.small[points]
        w_hash, w_line = word_hash(small, w_start, w_size), line_of[w_start]
        is_common = _member(w_hash, self.common)
        w_end = points[w_start + w_size - 1] if len(w_start) else np.empty(0, np.uint32)
        korean = (w_end >= 0xAC00) & (w_end <= 0xD7A3)
        ending = korean & (w_size > 1) & _member(w_end, self.endings)
        words_in = np.bincount(w_line, minlength=n_lines)
        # layouts: most lines are plain for a reason the arrays can tell, the rest is looked at one by one
        def any_in(mask: np.ndarray) -> np.ndarray:
            return np.bincount(line_of[mask], minlength=n_lines) > 0

        at = lambda k: points[np.minimum(begin + k, len(points) - 1)]
        cls_at = lambda k: kind[np.minimum(begin + k, len(points) - 1)]
        alpha3 = np.ones(n_lines, bool)
        for k in range(3):
            c = cls_at(k)
            alpha3 &= (begin + k < ends) & (c != BLANK) & (c != MARK) & (c != STOP) & (c != COMMA) & (c != DIGIT)
        gap = np.zeros(len(points), bool)
        gap[:-1] = (points[:-1] == 32) & (points[1:] == 32)
        inside = (np.arange(len(points)) > begin[line_of]) & (np.arange(len(points)) < last[line_of])
        odd = any_in((points == 0x7C) | ((points == 9) | gap) & inside)
        tight = np.zeros(len(points), bool)
        tight[:-1] = ((points[:-1] == 0x2C) | (points[:-1] == 0x3B)) & (points[1:] != 32)
        marked = any_in((tight | (points == 0x3A) | (points == 0xFF1A)) & inside)
        dated = (cls_at(3) == BLANK) & ((cls_at(4) == DIGIT) | (cls_at(4) == BLANK))
        easy = alpha3 & ~odd & ~dated & (stopped | ~marked)
        layout = np.full(n_lines, _PLAIN)
        layout[empty] = _EMPTY
        dash = np.isin(at(0), _points("-*+•·▪")) & (at(1) == 32) & (cls_at(2) != BLANK) & word_char[np.minimum(begin + 2, len(points) - 1)] & ~odd
        layout[dash & ~empty] = _BULLET
        for i in np.flatnonzero(~easy & ~empty & ~dash).tolist():
            layout[i] = self.layout(joined[begin[i] : last[i] + 1])
        front = np.flatnonzero((at(0) == 45) & ~empty & (last - begin == 2))
        for i in front.tolist():  # front matter
            if i == first_line[owner[i]] and joined[begin[i] : last[i] + 1] == "---":
                for j in range(i + 1, min(i + 20, first_line[owner[i] + 1])):
                    if joined[starts[j] : ends[j]].strip() == "---":
                        layout[i : j + 1] = _NEUTRAL
                        break
        # runs: single cells or labels are plain, a rule belongs to the table before it
        fresh = np.r_[True, (layout[1:] != layout[:-1]) | (owner[1:] != owner[:-1])]
        run = np.cumsum(fresh) - 1
        alone = np.bincount(run)[run] < 2
        layout = np.where(alone & ((layout == _CELLS) | (layout == _LABEL)), _PLAIN, layout)
        after = np.r_[False, (layout[:-1] == _CELL) & (owner[1:] == owner[:-1])]
        layout = np.where(layout == _RULE, np.where(after, _CELL, _NEUTRAL), layout)
        layout = np.where(layout == _CELLS, _CELL, np.where(layout == _LABEL, _BULLET, layout))
        fresh = np.r_[True, (layout[1:] != layout[:-1]) | (owner[1:] != owner[:-1])]
        run = np.cumsum(fresh) - 1
        head = np.flatnonzero(fresh)
        r_layout, r_owner, n_runs = layout[head], owner[head], len(head)
        r_counts = np.add.reduceat(counts, head, axis=0)
        size = ends - starts + 1
        r_size = np.add.reduceat(size, head)
        # function words
        w_run = run[w_line] if len(w_line) else w_line
        r_words = np.bincount(w_run, minlength=n_runs)
        r_common, r_end = np.bincount(w_run[is_common], minlength=n_runs), np.bincount(w_run[is_common | ending], minlength=n_runs)
        hangul, japanese, latin = r_counts[:, HANGUL], r_counts[:, HIRAGANA] + r_counts[:, KATAKANA] + r_counts[:, HAN], r_counts[:, LOWER] + r_counts[:, UPPER]
        some = np.maximum(r_words, 1)
        f = np.where(latin >= 2 * (hangul + japanese), r_common / some, np.where(japanese > hangul, r_counts[:, HIRAGANA] / np.maximum(japanese, 1), r_end / some))
        # words that are new
        pair = np.sort((w_run.astype(_U) << _U(40)) | (w_hash >> _U(24)))
        distinct = np.bincount((pair[np.r_[True, pair[1:] != pair[:-1]]] >> _U(40)).astype(np.int64), minlength=n_runs) if len(pair) else np.zeros(n_runs, np.int64)
        new = np.where(r_words >= 16, np.minimum(1.0, 2 * distinct / some**0.75), 1.0)
        spaceless = japanese > 0.3 * np.maximum(r_counts.sum(1), 1)
        bounds = np.r_[starts[head], len(points) + 1]
        for i in np.flatnonzero(spaceless & (r_size >= 60)).tolist():
            raw = joined[bounds[i] : bounds[i + 1] - 1].encode("utf-8", "surrogatepass")
            new[i] = min(1.0, 3 * len(zlib.compress(raw, 1)) / len(raw))
        # endless tokens
        seen = kind != BLANK
        edge = np.diff(np.r_[False, seen, False].astype(np.int8))
        t_start, t_size = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
        huge = t_size > 60
        long = np.bincount(run[line_of[t_start[huge]]], weights=t_size[huge], minlength=n_runs) / np.maximum(1, r_size)
        long = np.where(spaceless, 0.0, np.minimum(1.0, long))
        # layout of plain lines
        lines_in = np.where(stopped, 0, np.where(words_in > 8, 1, 2))
        lines_in = np.where(layout == _PLAIN, lines_in, np.select([layout == _BULLET, layout == _CELL, layout == _LOG, layout == _NOISE], [3, 4, 5, 6], 1))
        shape = np.bincount(run * 8 + lines_in, weights=size, minlength=n_runs * 8).reshape(n_runs, 8)[:, : len(SHAPES)]
        # few short lines, and a short line between longer ones, are no list
        few = (np.bincount(run, minlength=n_runs) < 3) & (r_layout == _PLAIN)
        shape[few, 1] += shape[few, 2]
        shape[few, 2] = 0
        p = np.zeros((n_runs, DIMS), np.float32)
        p[:, : len(CLASSES)] = r_counts / np.maximum(1, r_counts.sum(1, keepdims=True))
        p[:, len(CLASSES)], p[:, len(CLASSES) + 1] = f, 1 - f
        c = len(CLASSES) + 2
        p[:, c : c + len(SHAPES)] = shape / np.maximum(1, shape.sum(1, keepdims=True))
        p[:, -4], p[:, -3], p[:, -2], p[:, -1] = new, 1 - new, 1 - long, long
        judged = (r_layout != _NEUTRAL) & (r_layout != _EMPTY) & (r_counts.sum(1) > r_counts[:, BLANK])
        judged &= (r_words > 0) | (r_size > 20) | (r_layout != _PLAIN)
        t = lambda per_line: np.bincount(owner, weights=per_line, minlength=n_texts)
        return {
            "owner": r_owner, "size": r_size, "p": p, "judged": judged, "layout": r_layout, "f": f, "n_counts": r_counts, "n_words": r_words,
            "words": t(words_in), "letters": np.bincount(owner[w_line], weights=w_size, minlength=n_texts), "lines": t(~empty), "stopped": t(stopped), "common": np.bincount(owner[w_line[is_common]], minlength=n_texts),
            "counts": np.stack([t(counts[:, k]) for k in range(len(CLASSES))], 1), "chars": np.array([len(x) for x in texts]),
            "ends": (w_end[korean & stopped[w_line]], points[w_start[korean & stopped[w_line]]]) if len(w_start) else (w_end, w_end),
        }

    def measure(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Arrays over the texts: statistics, characters of each kind and the kind (index in KINDS)."""
        runs = self.runs(texts)
        near = self.profiles.divergences(runs["p"])
        kind = self.kind_of[near.argmin(1)]
        parts = np.zeros((len(texts), 5))
        np.add.at(parts, (runs["owner"], np.where(runs["judged"], kind, 4)), runs["size"])
        # The whole text's divergence from prose is that of its runs, by size.
        weight = np.where(runs["judged"], runs["size"], 0)
        far = np.bincount(runs["owner"], weights=near[:, self.prose].min(1) * weight, minlength=len(texts)) / np.maximum(1, np.bincount(runs["owner"], weights=weight, minlength=len(texts)))
        bad = parts[:, 1:4].sum(1)
        # Headings and front matter count as prose only where there is prose.
        whole = np.where(parts[:, 0] > 0, runs["chars"], np.maximum(1, runs["chars"] - parts[:, 4]))
        names = np.where(bad <= MAINLY * whole, 0, 1 + parts[:, 1:4].argmax(1))
        return runs | {"parts": parts, "kind": names, "divergence": np.maximum(0, far)}


def tidy(text: str) -> str:
    """Line feeds only, and width forms of letters as letters."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text.isascii() and WIDE.search(text):
        text = unicodedata.normalize("NFKC", text)
    return text


def _slices(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of together about HELD_CHARS characters, with the place of the first."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        held.append(tidy(t))
        size += len(t)
        if size > HELD_CHARS:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


SCHEMA = ("doc_id bigint, words bigint, mean_word_length double, symbol_ratio double, stop_line_share double, common_word_share double, "
          "prose_divergence double, prose_chars bigint, list_chars bigint, table_chars bigint, junk_chars bigint, kind string")  # fmt: skip


def measurer(common: frozenset[str], profiles: Profiles, spaceless: tuple[str, ...] = ()):
    """The function that measures batches of (doc_id, text)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = Profiler(common, profiles)
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for batch in batches:
            for first, texts in _slices([t or "" for t in batch.column("text").to_pylist()]):
                m = profiler.measure(texts)
                n, counts = np.maximum(1, m["words"]), m["counts"]
                known = m["common"].astype(np.float64)
                for i in np.flatnonzero(counts[:, [HIRAGANA, KATAKANA, HAN]].sum(1) > 0.3 * m["chars"]).tolist():  # no blanks between words: count occurrences
                    known[i] = min(m["words"][i], sum(map(texts[i].count, spaceless)))
                filled = m["chars"] > 0
                floats = [m["letters"] / n, counts[:, [STOP, COMMA, MARK]].sum(1) / np.maximum(1, m["chars"]), m["stopped"] / np.maximum(1, m["lines"]), known / n, np.where(filled, m["divergence"], 1.0)]
                kinds = pa.array([KINDS[k] if f else None for k, f in zip(m["kind"].tolist(), filled.tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, len(texts)), pa.array(m["words"].astype(np.int64)), *map(pa.array, floats),
                    *(pa.array(m["parts"][:, k].astype(np.int64)) for k in range(4)), kinds,
                ], names)

    return measure


def fitted(docs: DataFrame, common: frozenset[str], key: str = "doc_id", text: str = "text", lang: str | None = None, sample: int | None = None) -> Profiles:
    """Profiles fitted on all documents; only a caller that names ``sample`` has about that many, picked by a hash of the key.

    Each run of lines goes to its nearest first profile; the means of the runs of a profile, for prose
    per language that the document's label names, become the new profiles. Tasks send sums, no texts.
    """
    rows = docs.select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("text"), (label_language(lang) if lang else F.lit(None).cast("string")).alias("l")).filter("text <> ''")
    if sample is not None:
        rows = rows.filter(F.shiftrightunsigned(F.xxhash64("k"), 2) < F.lit(int((1 << 62) * min(1.0, sample / max(1, docs.count())))))
    seeds = Profiles.seeds()
    shared = docs.sparkSession.sparkContext.broadcast((common, seeds))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = Profiler(*shared.value)
        out: dict[tuple[int, str], np.ndarray] = {}
        read = 0
        for batch in batches:
            labels = batch.column("l").to_pylist()
            for first, texts in _slices(batch.column("text").to_pylist()):
                m = profiler.runs(texts)
                read += len(texts)
                near = profiler.profiles.divergences(m["p"]).argmin(1)
                told = np.array([1 + LANGUAGES.index(l) if l else 0 for l in labels[first : first + len(texts)]])[m["owner"]]
                fits = m["judged"] & (m["size"] >= 40)
                group = (near * (1 + len(LANGUAGES)) + np.where(profiler.prose[near], told, 0))[fits]
                order = np.argsort(group, kind="stable")
                group, own = group[order], m["p"][fits][order].astype(np.float64)
                head = np.flatnonzero(np.diff(group, prepend=-1))
                for g, n, total in zip(group[head].tolist(), np.diff(np.r_[head, len(group)]).tolist(), np.add.reduceat(own, head) if len(head) else (), strict=True):
                    k = (g // (1 + len(LANGUAGES)), ("", *LANGUAGES)[g % (1 + len(LANGUAGES))])
                    out[k] = out.get(k, 0) + np.r_[float(n), total]
                for place, ends in enumerate(m["ends"]):
                    own, n = np.unique(ends, return_counts=True)
                    for point, times in zip(own.tolist(), n.tolist(), strict=True):
                        k = (-1 - place, chr(point))
                        out[k] = out.get(k, 0) + np.array([float(times)])
        out[-3, ""] = np.array([float(read)])
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.int32()), pa.array([k[1] for k in out], pa.string()), pa.array([v.tolist() for v in out.values()], pa.list_(pa.float64()))], ["profile", "label", "sums"])

    found = rows.mapInArrow(sums, "profile int, label string, sums array<double>")
    each = found.select("profile", "label", F.posexplode("sums").alias("at", "x")).groupBy("profile", "label", "at").agg(F.sum("x").alias("x"))
    merged: dict[tuple[int, str], dict[int, float]] = {}
    for r in each.collect():  # a row per profile, label and dimension, and per syllable of Korean script
        merged.setdefault((r.profile, r.label), {})[r.at] = r.x
    least = max(LEAST_RUNS, LEAST_SHARE * merged.get((-3, ""), {0: 0.0})[0])
    names, kinds, rows_ = list(seeds.names), list(seeds.kinds), seeds.rows.copy()
    for i in range(len(seeds.names)):
        own = {l: np.array([v[k] for k in range(DIMS + 1)]) for (p, l), v in merged.items() if p == i}
        n = sum((v[0] for v in own.values()), 0.0)
        if n >= least:
            rows_[i] = sum(v[1:] for v in own.values()) / n
        for label in LANGUAGES:
            if label in own and own[label][0] >= least:
                names.append(f"{seeds.names[i]} {label}"), kinds.append(seeds.kinds[i])
                rows_ = np.vstack([rows_, own[label][1:] / own[label][0]])
    last = {l: v[0] for (p, l), v in merged.items() if p == -1}
    start = {l: v[0] for (p, l), v in merged.items() if p == -2}
    heard, begun = sum(last.values()), sum(start.values())
    endings = KOREAN_ENDINGS
    if heard >= 500:
        endings = "".join(sorted(c for c, n in last.items() if n >= 0.004 * heard and n / heard >= 1.5 * start.get(c, 0) / max(1, begun)))
    return Profiles(names, kinds, rows_, endings or KOREAN_ENDINGS)


def text_statistics(docs: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = None) -> DataFrame:
    """One row of statistics per document (see SCHEMA); repeated rows count once.

    ``words``, ``mean_word_length``, ``symbol_ratio`` (neither letters, digits nor blanks), ``stop_line_share``
    (non-empty lines that end in a sentence stop), ``common_word_share``, ``prose_divergence`` (weighted
    Jensen-Shannon divergence to the nearest prose profile), the characters of each kind of run, and ``kind``:
    prose, list, table or junk. Null and empty texts have zeros and kind null. ``lang`` names the column
    whose labels tell prose profiles of different languages apart; without it there is one per script.
    """
    listed = common_words.select(F.lower("word").alias("w")).filter("w is not null").distinct().limit(MOST_COMMON_WORDS + 1).collect()
    if len(listed) > MOST_COMMON_WORDS:
        raise ValueError(f"more than {MOST_COMMON_WORDS} common words")
    common = frozenset(r.w for r in listed if WORD.fullmatch(r.w))
    joined = tuple(r.w for r in listed if r.w and all(_class(c) in (HIRAGANA, KATAKANA, HAN) for c in r.w))
    shared = docs.sparkSession.sparkContext.broadcast((common, fitted(docs, common, key, text, lang), joined))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return measurer(*shared.value)(batches)

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(measure, SCHEMA).dropDuplicates(["doc_id"])

"""Languages of texts and of their sentences by bit-sliced Bloom filters of n-grams.

Each cell of the filter holds a bit per language, 64 languages to a slice, so one look-up of an n-gram (the
AND of its cells) returns all languages that contain it. The hits of a sentence are counted per language,
corrected for the false positives each language's fill lets through, and the language with the largest share
wins; where even that share is small, the sentence is in none of the languages known.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.llm.hashing import mix as _mix

LANGUAGES = ("ko", "en", "ja", "de", "fr", "es")
# Three-letter codes of these languages (terminological and bibliographic).
THREE_LETTERS = {"kor": "ko", "eng": "en", "jpn": "ja", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es"}
#: Rows per language the filters are fitted on, whole texts: the bound of the training sample.
SAMPLE_ROWS = 400
#: Common words up to this number are fitted on; more are an error.
MOST_COMMON_WORDS = 200_000
#: A sentence of whose n-grams the best language holds less than this is of no known language.
LEAST_SHARE = 0.3
CELLS, HASHES, SIZES = 1 << 19, 3, (1, 2, 3, 4)
#: An n-gram belongs to a language if it is at least this frequent there relative to the language where it is most frequent.
LEAST_RELATIVE = 0.2
#: Words whose counts a task keeps between batches.
KEPT_WORDS = 200_000
_U = np.uint64

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
FENCE = re.compile(r"\s*(```|~~~)")
BULLET = re.compile(r"\s*(?:[-*+•]|\(?\d{1,4}[.)]|\[[ xX]\])\s+\S")
SENTENCE_END = re.compile(r"[.!?]+[\"'”’»)\]]*(?=\s|\Z)|[。！？]+[\"'”’»)\]]*")
GAPS = re.compile(r"\S(?: {3,}|\t)\S")
LOG = re.compile(r"[\[(]?\d{4}-\d\d-\d\d[ T]|[\[(]?\d\d:\d\d:\d\d")
CELLS_LINE = re.compile(r"[^,;]{1,40}(?:,[^\s,][^,]{0,39}){2,}$|[^,;]{1,40}(?:;[^\s;][^;]{0,39}){2,}$")
CODE = re.compile(r"\s*(?:def |for .*:$|if .*:$|while .*:$|return |import |from \S+ import |class |[\w.]+\s*=\s|[\w.\[\]\"']+\(.*\)\s*$|[{}<])")


def label_language(column: Column | str, languages: tuple[str, ...] = LANGUAGES, three_letters: dict[str, str] = THREE_LETTERS) -> Column:
    """The two-letter language a label names (two letters, three letters, or two with a region, in any case), else null."""
    label = F.lower(F.trim(F.col(column) if isinstance(column, str) else column))
    two = F.regexp_extract(label, r"^([a-z]{2})(?:[-_][a-z0-9]{2,4})?$", 1)
    named = F.create_map(*[F.lit(x) for pair in three_letters.items() for x in pair])
    return F.coalesce(F.when(two.isin(*languages), two), named[label])


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Spans of the full sentences of the prose of a markdown text; headings, code, lists, tables and data are left out."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    at, fence, start = 0, False, -1  # start: where the current paragraph of prose began
    end = 0

    def close() -> None:
        nonlocal start
        if start >= 0:
            begin = start
            for m in SENTENCE_END.finditer(text, start, end):
                a, b = begin, m.end()
                begin = b
                while a < b and text[a] in " \t\r\n>":
                    a += 1
                body = text[a:b]
                if not body:
                    continue
                letters = sum(map(str.isalpha, body))
                wide = max(body) >= "぀"
                if letters * 2 > len(body) and (len(body.split()) >= 3 or wide and letters >= 6):
                    out.append((a, b))
        start = -1

    for line in text.split("\n"):
        nxt = at + len(line) + 1
        flat = line.strip()
        if FENCE.match(line):
            fence = not fence
            close()
        elif fence or not flat or flat[0] in "#|" or BULLET.match(line) or LOG.match(flat) or GAPS.search(flat) or CELLS_LINE.match(flat) or CODE.match(line) and flat[-1] not in ".!?。！？":
            close()
        else:
            if start < 0:
                start = at
            end = at + len(line)
        at = nxt
    close()
    return out


# ----------------------------------------------------------------------------- n-grams
def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(owner, hash)`` of the character n-grams of each word, with marks at its ends, and of the whole word."""
    marked = [f"\x02{w}\x03" for w in words]
    counts = np.array([len(m) for m in marked], np.int64)
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    owner = np.repeat(np.arange(len(words)), counts)
    owners, hashes = [], []
    for n in SIZES:
        m = len(points) - n + 1
        if m < 1:
            continue
        code = np.full(m, n, _U)
        with np.errstate(over="ignore"):
            for k in range(n):
                code = _mix(code * _U(0x9E3779B97F4A7C15) + points[k : k + m])
        inside = owner[:m] == owner[n - 1 :]
        if n == 1:
            inside &= points > 127
        owners.append(owner[:m][inside]), hashes.append(code[inside])
    if len(words):
        with np.errstate(over="ignore"):
            place = np.arange(len(points)) - np.repeat(np.cumsum(counts) - counts, counts)
            whole = np.add.reduceat(_mix(points + (place.astype(_U) << _U(32))), np.cumsum(counts) - counts)
        owners.append(np.arange(len(words))), hashes.append(_mix(whole))
    return np.concatenate(owners) if owners else np.empty(0, np.int64), np.concatenate(hashes) if hashes else np.empty(0, _U)


class Filters:
    """The bit-sliced filter: ``cells`` holds a bit per language, in one byte for up to eight, else in slices of 64 bits."""

    def __init__(self, languages: tuple[str, ...] = LANGUAGES):
        self.languages = tuple(languages)
        self.width = 8 if len(self.languages) <= 8 else 64
        self.word = np.uint8 if self.width == 8 else _U
        self.cells = np.zeros((-(-max(1, len(self.languages)) // self.width), CELLS), self.word)
        self.false = np.zeros(len(self.languages))
        self.forget()

    def _cells(self, hashes: np.ndarray) -> list[np.ndarray]:
        return [((hashes >> _U(20 * k)) & _U(CELLS - 1)).astype(np.int64) for k in range(HASHES)]

    def add(self, language: int, hashes: np.ndarray) -> None:
        part, bit = divmod(language, self.width)
        for at in self._cells(hashes):
            self.cells[part, at] |= self.word(1 << bit)  # the same bit whatever the order, so repeats do no harm

    def settle(self) -> None:
        """False positive rate per language, from the share of its bits that are set."""
        self.false = np.array([self.bits(self.cells, i).mean() for i in range(len(self.languages))]) ** HASHES

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """(slices, n-grams): the languages of each n-gram."""
        a, b, c = self._cells(hashes)
        return self.cells[:, a] & self.cells[:, b] & self.cells[:, c]

    def bits(self, masks: np.ndarray, language: int) -> np.ndarray:
        part, bit = divmod(language, self.width)
        return ((masks[part] >> self.word(bit)) & self.word(1)).astype(np.float64)

    def forget(self) -> None:
        """Empties the store of words met so far."""
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.languages) + 1))

    def _learn(self, fresh: list[str]) -> None:
        owner, hashes = grams(fresh)
        masks = self.masks(hashes)
        first, need = len(self.known), len(self.known) + len(fresh)
        if need > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(need, 2 * len(self.rows)) - len(self.rows), self.rows.shape[1]))])
        for i in range(len(self.languages)):
            self.rows[first:need, i] = np.bincount(owner, weights=self.bits(masks, i), minlength=len(fresh))
        self.rows[first:need, -1] = np.bincount(owner, minlength=len(fresh))
        self.known.update(zip(fresh, range(first, need), strict=True))

    def word_counts(self, words: list[str]) -> np.ndarray:
        """(words, languages + 1): hits per language and the number of n-grams, of each word."""
        if len(self.known) > KEPT_WORDS:
            self.forget()
        fresh = list(dict.fromkeys(w for w in words if w not in self.known))
        if fresh:
            self._learn(fresh)
        return self.rows[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def shares(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): share of the n-grams a language contains, corrected for false positives."""
        lists = [WORD.findall(t.lower()) for t in texts]
        sizes = np.array([len(x) for x in lists])
        counts = self.word_counts([w for x in lists for w in x])
        owner = np.repeat(np.arange(len(texts)), sizes)
        sums = np.stack([np.bincount(owner, weights=counts[:, i], minlength=len(texts)) for i in range(counts.shape[1])], 1)
        n = np.maximum(1, sums[:, -1:])
        return np.clip((sums[:, :-1] / n - self.false) / np.maximum(1e-9, 1 - self.false), 0, 1)

    def best(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(language, confidence)`` of each text: its index, or -1 where no language holds LEAST_SHARE of the n-grams, and one less the runner-up's share over the winner's."""
        if not texts or not self.languages:
            return np.full(len(texts), -1), np.zeros(len(texts))
        share = self.shares(texts)
        place, top = share.argmax(1), np.sort(np.c_[np.zeros(len(share)), share], 1)
        sure = np.where(top[:, -1] > 0, 1 - top[:, -2] / np.maximum(top[:, -1], 1e-12), 0.0)
        known = top[:, -1] >= LEAST_SHARE
        return np.where(known, place, -1), np.where(known, sure, 0.0)


def fit(samples: dict[str, list[str]], words: dict[str, list[str]] | None = None, rounds: int = 2, languages: tuple[str, ...] = LANGUAGES) -> Filters:
    """Filters from texts by (possibly wrong) language label, and from lists of frequent words.

    An n-gram is entered for the languages in which it is frequent relative to where it is most frequent, so
    that texts with a wrong label leave no trace; further rounds assign each sentence of the sample by the
    filters of the round before.
    """
    by = {name: [t[a:b].lower() for t in samples.get(name, []) for a, b in sentences(t)] for name in languages}
    filters = None
    for _ in range(rounds):
        if filters is not None:
            pool = [s for own in by.values() for s in own]
            best = filters.best(pool)[0] if pool else []
            by = {name: [s for s, i in zip(pool, best, strict=True) if languages[i] == name] for name in languages}
        codes, rates = [], []
        for name in languages:
            _, hashes = grams([w for s in by[name] for w in WORD.findall(s)])
            own, n = np.unique(hashes, return_counts=True)
            codes.append(own), rates.append(n / max(1, n.sum()))
        everything = np.unique(np.concatenate(codes))
        rate = np.zeros((len(everything), len(languages)))
        for i, (own, r) in enumerate(zip(codes, rates, strict=True)):
            rate[np.searchsorted(everything, own), i] = r
        belongs = (rate > 0) & (rate >= LEAST_RELATIVE * rate.max(1, keepdims=True))
        filters = Filters(languages)
        for i, name in enumerate(languages):
            filters.add(i, everything[belongs[:, i]])
            if words and words.get(name):
                filters.add(i, grams([w.lower() for w in words[name]])[1])
        filters.settle()
        filters.forget()
    return filters


def fitted(df: DataFrame, text: str, label: str, common_words: DataFrame | None = None, rows: int = SAMPLE_ROWS,
           languages: tuple[str, ...] = LANGUAGES, three_letters: dict[str, str] = THREE_LETTERS) -> Filters:
    """Filters fitted on at most ``rows`` labelled texts per language, picked by a hash of the text from the whole table.

    The labels are counted first; then only texts whose hash lies below a threshold set by these counts
    leave their task, about twice ``rows`` per language, so what reaches the driver does not grow with the table.
    """
    named = df.select(F.col(text).cast("string").alias("t"), label_language(label, languages, three_letters).alias("l")).filter("l is not null and length(t) >= 20")
    counts = {r.l: r.n for r in named.groupBy("l").agg(F.count("*").alias("n")).collect()}
    span = 1 << 62
    limits = F.create_map(*[F.lit(x) for l, n in counts.items() for x in (l, int(span * min(1.0, (2 * rows + 50) / n)))]) if counts else None
    samples: dict[str, list[str]] = {}
    if limits is not None:
        hashed = named.withColumn("h", F.shiftrightunsigned(F.xxhash64("t"), 2))
        picked = hashed.filter(F.col("h") < limits[F.col("l")]).select("l", "h", "t").groupBy("l", "h").agg(F.min("t").alias("t"))
        for r in sorted(picked.collect(), key=lambda r: (r.l, r.h)):
            if len(samples.setdefault(r.l, [])) < rows:
                samples[r.l].append(r.t)
    words: dict[str, list[str]] = {}
    if common_words is not None:
        listed = common_words.select(label_language("lang", languages, three_letters).alias("l"), "word").filter("l is not null and word is not null").distinct().limit(MOST_COMMON_WORDS + 1).collect()
        if len(listed) > MOST_COMMON_WORDS:
            raise ValueError(f"more than {MOST_COMMON_WORDS} common words")
        for r in sorted(listed, key=lambda r: (r.l, r.word)):
            words.setdefault(r.l, []).append(r.word)
    return fit(samples, words, languages=languages)


# ----------------------------------------------------------------------------- documents
SEGMENT = "struct<start:int,length:int,language:string,confidence:double>"


def detected(df: DataFrame, keys: list[str], text: str, filters: Filters) -> DataFrame:
    """``<keys>, language, confidence, segments``: one row per row of ``df``.

    ``segments`` are the runs of neighbouring sentences of one language (start and length in characters).
    ``language`` is the one of most sentence characters. A confidence is one less the runner-up's share of
    n-grams over the winner's, of a text the mean of its sentences by length. A sentence that fits none of
    the languages has language null and confidence 0. Texts without a full sentence, null ones included, have
    language null, confidence 0 and no segments.
    """
    shared = df.sparkSession.sparkContext.broadcast(filters)
    slim = df.select(*keys, F.col(text).cast("string").alias("_text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema[:-1])
    segment_type = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("language", pa.string()), ("confidence", pa.float64())]))

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            spans = [sentences(t) for t in texts]
            best, sure = model.best([t[a:b] for t, own in zip(texts, spans, strict=True) for a, b in own])
            names = [model.languages[k] if k >= 0 else None for k in best.tolist()]
            trusts, segments, languages, confidences, i = sure.tolist(), [], [], [], 0
            for own in spans:
                runs, weight, chars, trust = [], {}, 0, 0.0
                for a, b in own:
                    name, part = names[i], trusts[i] * (b - a)
                    weight[name] = weight.get(name, 0) + b - a
                    chars += b - a
                    trust += part
                    if runs and runs[-1][2] == name:
                        runs[-1][1], runs[-1][3], runs[-1][4] = b, runs[-1][3] + part, runs[-1][4] + b - a
                    else:
                        runs.append([a, b, name, part, b - a])
                    i += 1
                segments.append([{"start": a, "length": b - a, "language": n, "confidence": c / w} for a, b, n, c, w in runs])
                languages.append(max(weight, key=lambda n: (weight[n], n or "")) if weight else None)
                confidences.append(trust / chars if chars else 0.0)
            columns = [batch.column(k) for k in keys]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(languages, pa.string()), pa.array(confidences, pa.float64()), pa.array(segments, segment_type)], [*keys, "language", "confidence", "segments"])

    return slim.mapInArrow(detect, f"{kinds}, language string, confidence double, segments array<{SEGMENT}>")


def segments_of(df: DataFrame, keys: list[str], text: str, filters: Filters) -> DataFrame:
    """:func:`detected`, with one row per key; copies of a key agree in their text, so they meet after their texts are gone."""
    return detected(df, keys, text, filters).dropDuplicates(keys)


def mislabelled(df: DataFrame, keys: list[str], text: str, label: str, filters: Filters) -> DataFrame:
    """``<keys>, language``: of texts with full sentences in several languages, or whose label names another language than theirs, one row per language found.

    Sentences of no known language are left out; repeated rows of a key give one row per language.
    """
    rows = df.select(*keys, F.col(text).cast("string").alias("_t"), label_language(label, filters.languages).alias("named"))
    found = detected(rows, [*keys, "named"], "_t", filters)
    seen = F.filter(F.array_distinct(F.transform("segments", lambda s: s["language"])), lambda x: x.isNotNull())
    wrong = found.withColumn("seen", seen).filter("size(seen) > 1 or (size(seen) = 1 and not (named <=> seen[0]))")
    return wrong.select(*keys, F.explode("seen").alias("language")).distinct()

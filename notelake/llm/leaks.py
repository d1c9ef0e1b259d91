"""Held-out test passages inside a training corpus."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.rows import once

WORD = re.compile(r"[^\W_]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Passages of more n-grams, or more characters, than this in all are not sent to the tasks but joined. An n-gram takes 24 bytes there, a word 8 and its text.
MOST_WINDOWS, MOST_CHARS = 4_000_000, 64_000_000
#: Words whose hashes a task keeps between batches.
KEPT_WORDS = 500_000
#: Parts a frequent n-gram of the corpus is spread over in the join.
SALT = 16


def words_of(text: str | None) -> list[str]:
    """Unbroken runs of letters and digits after compatibility composition, in lower case."""
    if not text:
        return []
    return WORD.findall((text if text.isascii() else unicodedata.normalize("NFKC", text)).lower())


def _windows(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit polynomial hash of each run of ``n`` word ids."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(ids) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _STEP + ids[k : len(ids) - n + 1 + k]
    return out


class WordHashes:
    """64-bit hashes of words, kept between batches up to a bound."""

    def __init__(self, kept: int = KEPT_WORDS):
        self.kept, self.known = kept, {}

    def of(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.kept:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


class PassageIndex:
    """The n-grams of the passages in flat arrays, for one look-up of all windows of a batch at once.

    ``hashes`` is sorted, with the item and first word of each n-gram beside it; the words themselves lie in
    one packed text, from which every hit is verified.
    """

    def __init__(self, passages: list[tuple[int, str]], n: int):
        self.n, hashing = n, WordHashes()
        hashes, items, places, sizes, packed, words_before = [], [], [], [], [], 0
        for item, text in passages:
            words = words_of(text)
            if len(words) < n:
                continue
            windows = _windows(hashing.of(words), n)
            hashes.append(windows), items.append(np.full(len(windows), item, np.int64)), places.append(np.arange(len(windows)) + words_before)
            sizes += map(len, words)
            packed.append(" ".join(words))
            words_before += len(words)
        order = np.argsort(np.concatenate(hashes), kind="stable") if hashes else np.empty(0, np.int64)
        self.hashes = np.concatenate(hashes)[order] if hashes else np.empty(0, np.uint64)
        self.items = np.concatenate(items)[order] if hashes else np.empty(0, np.int64)
        self.places = np.concatenate(places)[order] if hashes else np.empty(0, np.int64)
        self.starts = np.r_[0, np.cumsum(np.array(sizes, np.int64) + 1)]
        self.packed = " ".join(packed)

    def hits(self, texts: list[str | None], hashing: WordHashes) -> list[dict[int, list[tuple[int, int]]]]:
        """For each text the items found in it, each with its word windows (first word, word after the last)."""
        found: list[dict[int, list[tuple[int, int]]]] = [{} for _ in texts]
        if not len(self.hashes):
            return found
        lists = [words_of(t) for t in texts]
        flat = [w for words in lists for w in words]
        ends = np.cumsum([len(words) for words in lists])
        owner = np.repeat(np.arange(len(lists)), [len(words) for words in lists])
        windows = _windows(hashing.of(flat), self.n)
        first = np.searchsorted(self.hashes, windows)
        for i in np.flatnonzero(self.hashes[np.minimum(first, len(self.hashes) - 1)] == windows).tolist():
            doc = owner[i]
            if i + self.n > ends[doc]:
                continue
            said, start = " ".join(flat[i : i + self.n]), int(i - (ends[doc] - len(lists[doc])))
            k = first[i]
            while k < len(self.hashes) and self.hashes[k] == windows[i]:
                place = self.places[k]
                if self.packed[self.starts[place] : self.starts[place + self.n] - 1] == said:
                    spans = found[doc].setdefault(int(self.items[k]), [])
                    if not spans or spans[-1][0] != start:
                        spans.append((start, start + self.n))
                k += 1
        return found


def _slim(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))


def _items(passages: DataFrame, key: str, text: str, n: int) -> tuple[DataFrame, int, int]:
    """``(key, text)`` of the passages, the number of their n-grams and of the characters of those that have any."""
    items = _slim(passages, key, text).filter("key is not null and text is not null").distinct()

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            windows = [max(0, len(words_of(t)) - n + 1) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(windows, pa.int64()), pa.array([len(t) if w else 0 for t, w in zip(texts, windows, strict=True)], pa.int64())], ["windows", "chars"])

    total = items.select("text").mapInArrow(size, "windows bigint, chars bigint").agg(F.coalesce(F.sum("windows"), F.lit(0)), F.coalesce(F.sum("chars"), F.lit(0))).first()
    return items, total[0], total[1]


def _index(docs: DataFrame, items: DataFrame, n: int):
    shown = items.filter(f"length(text) >= {2 * n - 1}").collect()  # at most MOST_CHARS characters, and texts of fewer words than n
    return docs.sparkSession.sparkContext.broadcast(PassageIndex([(r.key, r.text) for r in shown], n))


def leaked_items(docs: DataFrame, passages: DataFrame, n: int = 13, key: str = "doc_id", text: str = "text",
                 item_key: str = "item_id", passage_text: str = "text", most_windows: int = MOST_WINDOWS) -> DataFrame:
    """``doc_id, item_id``: each document and item with ``n`` or more consecutive words in common.

    The passages' n-grams travel to the tasks as one sorted set if there are at most ``most_windows`` of them
    (counted first); beyond that both sides are hashed and joined. Null and empty texts, and passages of
    fewer than ``n`` words, match nothing; repeated rows give one pair.
    """
    items, windows, chars = _items(passages, item_key, passage_text, n)
    if windows > most_windows or chars > MOST_CHARS:
        return _joined(docs, items, n, key, text).select("doc_id", "item_id").distinct()
    index = _index(docs, items, n)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = WordHashes()
        for batch in batches:
            found = index.value.hits(batch.column("text").to_pylist(), hashing)
            keys = batch.column("key").to_pylist()
            pairs = [(k, item) for k, f in zip(keys, found, strict=True) for item in f]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["doc_id", "item_id"])

    return _slim(docs, key, text).filter("text <> ''").mapInArrow(scan, "doc_id bigint, item_id bigint").distinct()


def _gram_rows(df: DataFrame, n: int) -> DataFrame:
    """``key, at, gram``: the n-grams of each text as text with the place of the first word, for joins."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(t)
                for a in range(0, len(words) - n + 1, 50_000):
                    own = [" ".join(words[i : i + n]) for i in range(a, min(a + 50_000, len(words) - n + 1))]
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(own), pa.int64()), pa.array(np.arange(a, a + len(own)), pa.int64()), pa.array(own, pa.string())], ["key", "at", "gram"])

    return df.mapInArrow(grams, "key bigint, at bigint, gram string")


def _joined(docs: DataFrame, items: DataFrame, n: int, key: str, text: str) -> DataFrame:
    """``doc_id, at, item_id``, without a broadcast: n-grams of both sides meet by their text.

    The items' side is reduced to different n-grams per item and repeated once per salt, so that an n-gram a
    large part of the corpus holds is spread over SALT tasks.
    """
    left = _gram_rows(_slim(docs, key, text).filter("text <> ''"), n).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALT)).cast("int"))
    right = _gram_rows(items, n).select(F.col("key").alias("item_id"), "gram").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    left, right = (x.withColumn("h", F.xxhash64("gram")) for x in (left, right))
    return left.join(right, ["h", "gram", "salt"]).select(F.col("key").alias("doc_id"), "at", "item_id")


def _cut(text: str, firsts: list[int], n: int, max_share: float) -> tuple[str | None, int, bool]:
    """``(text, removed words, dropped)`` without the n-grams that begin at these words."""
    composed = unicodedata.normalize("NFKC", text)
    if len(composed.lower()) != len(composed):  # else spans of the lowered words would be off
        composed = composed.lower()
    spans = [m.span() for m in WORD.finditer(composed)]
    bad = sorted({w for a in firsts for w in range(a, a + n)})
    if len(bad) > max_share * len(spans):
        return None, len(bad), True
    kept, last = [], 0
    for run in np.split(np.array(bad), np.flatnonzero(np.diff(bad) > 1) + 1):
        kept.append(composed[last : spans[run[0]][0]])
        last = spans[run[-1]][1]
    return "".join([*kept, composed[last:]]), len(bad), False


def without_leaks(docs: DataFrame, passages: DataFrame, n: int = 13, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", passage_text: str = "text", max_share: float = 0.5, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """``doc_id, text, removed_words, dropped``: each document with leaked word spans cut out.

    A document of which more than ``max_share`` of the words leak is dropped whole (text null). Documents
    without hits keep their text as it is; null texts stay null; rows of one key count once. The passages
    travel to the tasks under the bound of :func:`leaked_items`; beyond it the places of leaked n-grams come
    from a join and only documents that have any are met by them.
    """
    items, windows, chars = _items(passages, item_key, passage_text, n)
    rows = once(_slim(docs, key, text), ["key"])
    names, schema = ["doc_id", "text", "removed_words", "dropped"], "doc_id bigint, text string, removed_words bigint, dropped boolean"

    def batch_of(keys: pa.Array, out: list[tuple[str | None, int, bool]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.bool_())], names)

    if windows <= most_windows and chars <= MOST_CHARS:
        index = _index(docs, items, n)

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashing = WordHashes()
            for batch in batches:
                texts = batch.column("text").to_pylist()
                found = index.value.hits(texts, hashing)
                yield batch_of(batch.column("key"), [_cut(t, [a for spans in f.values() for a, _ in spans], n, max_share) if f else (t, 0, False) for t, f in zip(texts, found, strict=True)])

        return rows.mapInArrow(clean, schema)

    hit = _joined(docs, items, n, key, text).groupBy(F.col("doc_id").alias("key")).agg(F.collect_set("at").alias("firsts"))  # at most a place per word of the document

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("text").to_pylist(), batch.column("firsts").to_pylist(), strict=True)
            yield batch_of(batch.column("key"), [_cut(t, f, n, max_share) if f else (t, 0, False) for t, f in pairs])

    return rows.join(hit, "key", "left").select("key", "text", "firsts").mapInArrow(cut, schema)

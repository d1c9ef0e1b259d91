"""Mixing sources to target shares of the total token count, with a cap on repeats."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelake.runtime import broadcast_if_bounded, cut_lineage, default_parallelism, spread

#: Target sources up to this number are sent to all tasks; beyond it they are joined by key.
MOST_SENT = 100_000
#: Where the vocabulary lies; a parameter of every function that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Tokens of the mix a task puts in order, about 60 MB of text.
TOKENS_PER_TASK = 16_000_000

# Fixed value: the pattern this public vocabulary splits text with before its merges.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("public", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(df: DataFrame, text: str = "text", out: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with the token count of ``text`` under a public byte-level vocabulary; null and '' count 0."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(vocabulary).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], index=texts.index)

    return df.withColumn(out, count(F.col(text)))


def clean_source(column: Column | str) -> Column:
    """Source names compare trimmed and in lower case."""
    return F.lower(F.regexp_replace(F.col(column) if isinstance(column, str) else column, r"(?U)^\s+|\s+$", ""))


def _sized(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, source, text_key, tokens`` of each distinct document row, stored: texts are tokenised once, whatever is asked of the sizes."""
    rows = docs.select("doc_id", clean_source("source").alias("source"), F.col("text").cast("string").alias("text"))
    sized = with_token_counts(rows, vocabulary=vocabulary)
    return cut_lineage(sized.select("doc_id", "source", F.md5("text").alias("text_key"), "tokens").distinct())


def _targets(targets: DataFrame) -> DataFrame:
    """``source, target_share, max_repeats``, one row per cleaned source."""
    return (
        targets.select(clean_source("source").alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
        .filter("source is not null")
        .groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    )


def source_supply(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """What each target source has and needs.

    ``source, target_share, max_repeats, docs, own_tokens, total_tokens, wanted_tokens, rate, short``: the
    total is the tokens of all documents whose source is a target source, ``rate`` the wanted mean number
    of uses of a text, ``short`` whether max_repeats uses of every text still miss the share. Sources
    without documents have 0 tokens and are short if they have a share. Null sources belong nowhere; a
    document row that occurs twice counts once.
    """
    return _supply(_sized(docs, vocabulary), targets)


def _supply(sized: DataFrame, targets: DataFrame) -> DataFrame:
    own = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("own_tokens"))
    wanted = broadcast_if_bounded(_targets(targets), targets.limit(MOST_SENT + 1).count(), MOST_SENT)
    known = own.join(wanted, "source", "right").fillna(0, ["docs", "own_tokens"])
    total = F.sum("own_tokens").over(Window.partitionBy())  # one row per source
    wants = F.col("target_share") * F.col("total_tokens")
    return (
        known.withColumn("total_tokens", total)
        .withColumn("wanted_tokens", F.coalesce(wants, F.lit(0.0)))
        .withColumn("rate", F.when(F.col("own_tokens") > 0, F.col("wanted_tokens") / F.col("own_tokens")).otherwise(0.0))
        .withColumn("short", F.col("max_repeats") * F.col("own_tokens") < F.col("wanted_tokens"))
    )


def _window(mean: float) -> tuple[int, np.ndarray]:
    """``(first, p)``: the Poisson probabilities of first, first + 1, ..., outside of which less than 1e-15 lies."""
    reach = 12 * math.sqrt(mean) + 40
    first = max(0, math.floor(mean - reach))
    k = np.arange(first + 1, math.ceil(mean + reach) + 1)
    log_first = first * math.log(mean) - mean - math.lgamma(first + 1) if mean > 0 else 0.0
    with np.errstate(divide="ignore"):
        return first, np.exp(log_first + np.r_[0.0, np.cumsum(np.log(mean / k))])


def poisson_counts(u: np.ndarray, mean: float) -> np.ndarray:
    """The inverse of the Poisson distribution function at each of ``u`` in [0, 1), for any mean."""
    first, p = _window(mean)
    return first + np.searchsorted(np.cumsum(p), u, side="right")


def capped_mean(mean: float, cap: int) -> float:
    """The expectation of min(X, cap) for a Poisson variable X; the cap itself for an infinite mean."""
    if math.isinf(mean):
        return float(cap)
    first, p = _window(mean)
    return float(np.minimum(first + np.arange(len(p)), cap) @ p)


@lru_cache(maxsize=100_000)
def mean_for(rate: float, cap: int) -> float:
    """The Poisson mean whose draws, cut at ``cap``, average ``rate``; inf where only the cap itself is enough."""
    if cap <= 0 or rate <= 0:
        return 0.0
    if rate >= cap * (1 - 1e-9):
        return float("inf")
    low, high = rate, max(1.0, 2 * rate)
    while capped_mean(high, cap) < rate:
        high *= 2
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if capped_mean(middle, cap) < rate else (low, middle)
    return high


def level_for(copies: np.ndarray, tokens: np.ndarray, wanted: float, cap: int) -> float:
    """The rate per copy at which texts of so many copies, each used min(rate * copies, cap) times, sum up to ``wanted`` tokens; inf where the cap is too low."""
    if cap <= 0 or wanted >= cap * tokens.sum():
        return float("inf") if cap > 0 else 0.0
    order = np.argsort(-copies)
    c, t = copies[order].astype(float), tokens[order].astype(float)
    free, full = np.cumsum((c * t)[::-1])[::-1], np.r_[0.0, np.cumsum(t)[:-1]] * cap
    level = (wanted - full) / free  # with the texts of most copies at the cap, more and more of them
    return float(level[np.argmax(level * c <= cap * (1 + 1e-12))])


def replication(docs: DataFrame, targets: DataFrame, seed: int = 0, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, text_key, tokens, expected, uses``: how often each document goes into the mix.

    The number of uses of a text is a Poisson draw, inverted at a hash of (seed, source, text), so a rerun or
    a lost task draws the same. Draws are cut at max_repeats and the mean is raised so that the cut draws
    still average what is ``expected``. Copies of a text within a source count as one text, expected as many
    times more often, but not above max_repeats; what it loses to that the other texts of the source make up
    for. The uses fall to its smallest doc_id. Documents of no target source, null sources and empty texts
    are not used.
    """
    sized = _sized(docs, vocabulary)
    return _replicate(sized, _supply(sized, targets), targets, seed)


def _replicate(sized: DataFrame, supply: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    texts = sized.filter("tokens > 0").groupBy("source", "text_key").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"), F.count("*").alias("copies"))
    texts = cut_lineage(texts)
    few = targets.limit(MOST_SENT + 1).count()

    @F.pandas_udf("double")
    def level(lists: pd.Series, wanted: pd.Series, cap: pd.Series) -> pd.Series:
        rows = zip(lists, wanted, cap, strict=True)
        return pd.Series([level_for(np.array([x["copies"] for x in own]), np.array([x["tokens"] for x in own]), w, int(c)) for own, w, c in rows], dtype=float)

    # One row per number of copies that occurs in a source: at most the root of twice its documents.
    sums = texts.groupBy("source", "copies").agg(F.sum("tokens").alias("tokens")).groupBy("source").agg(F.collect_list(F.struct("copies", "tokens")).alias("sums"))
    cap = F.coalesce("max_repeats", F.lit(0))
    levels = sums.join(supply.select("source", "wanted_tokens", cap.alias("cap")), "source").withColumn("level", level("sums", "wanted_tokens", "cap")).select("source", "cap", "level")
    drawn = texts.join(broadcast_if_bounded(levels, few, MOST_SENT), "source")
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "source", "text_key"), F.lit(1 << 53)) / F.lit(float(1 << 53))).cast("double")

    @F.pandas_udf("struct<expected:double,uses:bigint>")
    def draw(u: pd.Series, level: pd.Series, cap: pd.Series, copies: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"expected": np.zeros(len(u)), "uses": np.zeros(len(u), np.int64)})
        for (own, most), at in pd.DataFrame({"r": np.minimum(level * copies, cap), "c": cap}).groupby(["r", "c"]).indices.items():
            mean = mean_for(float(own), int(most))
            out.loc[at, "expected"] = float(own)
            out.loc[at, "uses"] = most if math.isinf(mean) else np.minimum(poisson_counts(u.to_numpy(float)[at], mean), most)
        return out

    drawn = drawn.withColumn("_d", draw(uniform, "level", "cap", "copies"))
    return drawn.select("doc_id", "source", "text_key", "tokens", "_d.expected", "_d.uses")


def reached_shares(docs: DataFrame, targets: DataFrame, seed: int = 0, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per target source: what its share is, what the draws can reach and what they did reach.

    ``source, target_share, max_repeats, short, docs_used, uses, wanted_tokens, expected_tokens, mix_tokens,
    reached_share, most_uses``. ``expected_tokens`` is the expectation of the cut draws; where it stays below
    ``wanted_tokens``, max_repeats or copies stand in the way. ``short`` tells whether max_repeats uses of
    every document would miss the share.
    """
    sized = _sized(docs, vocabulary)
    supply = cut_lineage(_supply(sized, targets))
    used = _replicate(sized, supply, targets, seed).groupBy("source").agg(
        F.count(F.when(F.col("uses") > 0, 1)).alias("docs_used"), F.sum("uses").alias("uses"), F.sum(F.col("uses") * F.col("tokens")).alias("mix_tokens"),
        F.sum(F.col("expected") * F.col("tokens")).alias("expected_tokens"), F.max("uses").alias("most_uses"),
    )
    report = supply.join(used, "source", "left").fillna(0, ["docs_used", "uses", "mix_tokens", "most_uses"]).fillna(0.0, ["expected_tokens"])
    all_tokens = F.sum("mix_tokens").over(Window.partitionBy())  # one row per source
    share = F.when(all_tokens > 0, F.col("mix_tokens") / all_tokens).otherwise(0.0).alias("reached_share")
    return report.select("source", "target_share", "max_repeats", "short", "docs_used", "uses", "wanted_tokens", "expected_tokens", "mix_tokens", share, "most_uses")


def short_sources(docs: DataFrame, targets: DataFrame, seed: int = 0, vocabulary: str = VOCABULARY) -> DataFrame:
    """``source``: sources whose draws, cut at max_repeats, fall short of their share even where every draw is at the cap."""
    return reached_shares(docs, targets, seed, vocabulary).filter("short and mix_tokens < wanted_tokens").select("source")


def mixed(docs: DataFrame, targets: DataFrame, seed: int = 0, vocabulary: str = VOCABULARY, partitions: int | None = None) -> DataFrame:
    """``doc_id, source, text, use``: the mix itself, each document repeated by its uses, in shuffled order.

    The order is by a hash of (seed, document, use). As hashes are even, their ranges are known without a
    look at the rows: each task gets one range, so the order is global, reproducible and spread over all tasks
    whatever the size of a source.
    """
    plan = cut_lineage(replication(docs, targets, seed, vocabulary).filter("uses > 0").select("doc_id", "source", "uses", "tokens"))
    total = plan.agg(F.coalesce(F.sum(F.col("uses") * F.col("tokens")), F.lit(0))).first()[0]
    parts = partitions or max(default_parallelism(docs.sparkSession), spread(total, TOKENS_PER_TASK))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).dropDuplicates(["doc_id"])
    rows = plan.join(texts, "doc_id").withColumn("use", F.explode(F.sequence(F.lit(1), F.col("uses").cast("int"))))
    keyed = rows.withColumn("_at", F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "doc_id", "use"), 1))
    order = keyed.repartitionById(parts, F.floor(F.col("_at") / F.lit(2.0**63) * parts).cast("int"))
    return order.sortWithinPartitions("_at").select("doc_id", "source", "text", "use")

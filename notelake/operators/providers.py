"""Replaceable stages that need a model: interfaces as column functions, with offline defaults.

Each provider is a function from columns to a column, so a pandas function that holds a model fits as well
as a built-in expression. The defaults below need no model and no network; they stand in for one and
make no claim of its quality.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions import text as tx
from notelake.functions.vectors import hashed_embedding
from notelake.operators.retrieval import overlap_score

Embedder = Callable[[Column], Column]  # text -> array<float>
Reranker = Callable[[Column, Column], Column]  # query, content -> double
TokenCounter = Callable[[Column], Column]  # text -> int
Classifier = Callable[[Column], Column]  # text -> category
Extractor = Callable[[Column], Column]  # text -> JSON of concepts and relations

# Words that speak for a category in the offline classifier.
CATEGORY_WORDS = {
    "about": ("profile", "이력서", "bio", "introduction"),
    "career": ("interview", "면접", "portfolio", "salary", "meeting", "회의"),
    "study": ("experiment", "실험", "proof", "증명", "index", "색인", "lecture", "강의"),
    "writing": ("essay", "수필", "draft", "초안", "manuscript", "원고", "stanza"),
}
#: Characters of a text that the classifier reads unless told otherwise.
CLASSIFIED_CHARS = 2000

# Fixed value: the pattern byte-pair vocabularies of this kind split text with before their merges.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def byte_pairs(vocabulary: str) -> Callable[[str], int]:
    """The length of a text in tokens of a byte-pair vocabulary file (a line per token: base64 and rank); '' and None count 0."""
    import tiktoken

    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    encode = tiktoken.Encoding("vocabulary", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: len(encode(text)) if text else 0


def byte_pair_count(vocabulary: str) -> TokenCounter:
    """A token counter over a byte-pair vocabulary, one Arrow batch at a time."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        size = byte_pairs(vocabulary)
        return pd.Series([size(t) for t in texts], index=texts.index, dtype="int32")

    return count


def classify(text: Column, chars: int = CLASSIFIED_CHARS) -> Column:
    """The category with most of its words in the first ``chars`` characters, ties in text order; none gives the default."""
    words = tx.tokens(F.substring(text, 1, chars))

    def hits(listed: tuple[str, ...]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*listed)))

    scores = [F.struct((-hits(v)).alias("n"), F.lit(c).alias("c")) for c, v in CATEGORY_WORDS.items()]
    best = F.array_min(F.array(*scores))
    return F.when(best["n"] < 0, best["c"]).otherwise(tx.DEFAULT_CATEGORY)


def classified(df: DataFrame, text: str, classifier: Classifier = classify) -> DataFrame:
    return df.select("doc_id", classifier(F.col(text)).alias("category"))


def extract(text: Column) -> Column:
    """JSON with a concept per capitalised word of five letters or more, and a relation between neighbours."""
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])[A-Z][a-z]{4,}(?![A-Za-z0-9_])"), F.lit(0)))
    concepts = F.transform(names, lambda n: F.struct(n.alias("name"), F.array().cast("array<string>").alias("aliases"), F.lit("").alias("description")))
    pairs = F.zip_with(F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0))), F.slice(names, 2, F.greatest(F.size(names), F.lit(1))), lambda a, b: F.struct(a.alias("src"), b.alias("dst"), F.lit("related_to").alias("type")))
    return F.to_json(F.struct(concepts.alias("concepts"), F.filter(pairs, lambda p: p["dst"].isNotNull()).alias("relations")))


DEFAULTS: dict[str, Callable] = {"embed": hashed_embedding, "rerank": overlap_score, "count_tokens": tx.token_count, "classify": classify, "extract": extract}

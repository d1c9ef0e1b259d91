"""Ranked retrieval for batches of queries: lexical, vector, fusion, reranking, neighbours.

Queries are a data frame, so one job answers a whole batch. Corpus statistics always come from the whole
corpus; filters only restrict what may be returned. Scores are rounded before they are ranked and every
ranking has a total order, so results do not depend on how rows are spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelake.functions import text as tx
from notelake.operators.store import KEY
from notelake.runtime import broadcast_if_bounded, broadcast_if_small, cut_lineage, spread

K1, B = 1.2, 0.75
# Weights of the searched fields, and the constant of reciprocal rank fusion.
FIELDS = {"content": 1.0, "title": 0.5, "section_path": 0.3}
RRF_K = 60
CANDIDATES, TOP_K = 20, 5
DIGITS = 6
#: Distinct query terms, and queries, up to which the query side is broadcast.
MOST_TERMS, MOST_QUERIES = 1_000_000, 100_000
#: Query vectors a task multiplies at once; with 64 dimensions these are 512 kB.
VECTOR_BLOCK = 2048
#: Query vectors sent to all tasks as one matrix (51 MB with 64 dimensions); more are met in blocks of this size.
QUERY_BLOCK = 100_000


def query_terms(queries: DataFrame, query_id: str = "id", query: str = "query") -> DataFrame:
    """``query_id, term, n``: a term that occurs n times counts n times."""
    rows = queries.select(F.col(query_id).alias("query_id"), F.explode(tx.tokens(query)).alias("term"))
    return rows.groupBy("query_id", "term").agg(F.count("*").alias("n"))


def _ranked(df: DataFrame, k: int, by: str, out: str, ties: list[str] | None = None) -> DataFrame:
    """The k best rows of each query, numbered from 1; Spark limits the groups before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc(by), *(ties or KEY))
    return df.withColumn(out, F.row_number().over(order)).filter(F.col(out) <= k)


def field_texts(corpus: DataFrame, fields: dict[str, float]) -> DataFrame:
    """``doc_id, chunk_index, field, tokens, dl`` of each field with at least one token."""
    stacked = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tx.tokens(f).alias("tokens")) for f in fields]))
    texts = corpus.select(*KEY, stacked.alias("s")).select(*KEY, "s.field", "s.tokens").withColumn("dl", F.size("tokens"))
    return texts.filter("dl > 0")


def corpus_statistics(texts: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """``field, term, df, docs, avgdl`` of the terms asked for, over all texts.

    One pass: each text adds its different terms, and the empty term, which stands for the text as such; the
    counts are summed up in every task, so only a row per field and term is shuffled.
    """
    wanted = terms.select("term").distinct().unionByName(terms.sparkSession.range(1).select(F.lit("").alias("term")))
    once = texts.select("field", "dl", F.explode(F.array_append(F.array_distinct("tokens"), F.lit(""))).alias("term"))
    counts = once.join(broadcast_if_bounded(wanted, n_terms + 1, MOST_TERMS), "term", "left_semi").groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("dl").alias("dl"))
    one = F.max(F.when(F.col("term") == "", F.struct("df", "dl"))).over(Window.partitionBy("field"))  # a partition per field holds as many rows as terms were asked for
    return counts.withColumn("_all", one).filter("term <> ''").select("field", "term", "df", F.col("_all.df").alias("docs"), (F.col("_all.dl") / F.col("_all.df")).alias("avgdl"))


def term_frequencies(texts: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """``field, doc_id, chunk_index, term, tf, dl`` of the terms asked for.

    The other tokens are dropped right where a text is read, so what is aggregated follows the matches and
    not the corpus; a key's postings stay in its partition.
    """
    wanted = broadcast_if_bounded(terms.select("term").distinct(), n_terms, MOST_TERMS)
    postings = texts.select("field", *KEY, "dl", F.explode("tokens").alias("term")).join(wanted, "term", "left_semi")
    return postings.groupBy("field", *KEY, "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))


def bm25(corpus: DataFrame, queries: DataFrame, fields: dict[str, float] | None = None, k1: float = K1, b: float = B,
         query_id: str = "id", query: str = "query") -> DataFrame:
    """``query_id, doc_id, chunk_index, score`` of every chunk that holds a term of the query in any field.

    ``corpus`` has one row per key. A field's score is the sum over terms of idf * tf / (tf + k1 * (1 - b +
    b * dl / avgdl)); fields add up by their weights.
    """
    fields = fields or FIELDS
    terms = query_terms(queries, query_id, query)
    n_terms = terms.count()  # the query side only: bounds everything that is broadcast below
    texts = field_texts(corpus, fields)
    postings = term_frequencies(texts, terms, n_terms)
    weights = F.create_map(*[F.lit(x) for f, w in fields.items() for x in (f, float(w))])
    # One row per field and term of the queries: small wherever the terms are.
    known = corpus_statistics(texts, terms, n_terms).withColumn("idf", F.log1p((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * weights[F.col("field")])
    asked = known.join(broadcast_if_bounded(terms, n_terms, MOST_TERMS), "term").select("field", "term", "query_id", (F.col("n") * F.col("idf")).alias("weight"), "avgdl")
    scored = postings.join(broadcast_if_bounded(asked, n_terms * len(fields), MOST_TERMS), ["field", "term"])
    part = F.col("weight") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return scored.withColumn("part", part).groupBy("query_id", *KEY).agg(F.round(F.sum("part"), DIGITS).alias("score"))


def bm25_topk(corpus: DataFrame, queries: DataFrame, k: int = CANDIDATES, fields: dict[str, float] | None = None, allowed: DataFrame | None = None,
              pad: bool = False, query_id: str = "id", query: str = "query", scores: DataFrame | None = None) -> DataFrame:
    """``query_id, doc_id, chunk_index, score, bm25_rank``: the k best chunks of each query, by ``scores`` where a stored index gave them.

    ``allowed`` holds the keys, and optionally the query_id, that may be returned (all if None). With
    ``pad`` the list is filled up with allowed chunks of score 0 in key order, as an engine does whose
    match clause became optional because of a filter.
    """
    scores = bm25(corpus, queries, fields, query_id=query_id, query=query) if scores is None else scores
    if allowed is not None:
        scores = scores.join(allowed, [c for c in ("query_id", *KEY) if c in allowed.columns], "left_semi")
    best = _ranked(scores, k, "score", "bm25_rank")
    if not pad:
        return best
    pool = (corpus if allowed is None else allowed).select(*[c for c in ("query_id", *KEY) if allowed is not None and c in allowed.columns] or KEY)
    ids = queries.select(F.col(query_id).alias("query_id")).distinct()
    if "query_id" in pool.columns:
        first = pool.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(*KEY))).filter(f"_r <= {2 * k}").drop("_r")
    else:
        # 2k keys are enough, as at most k of them are in the list already; both sides are this small.
        first = pool.orderBy(*KEY).limit(2 * k).crossJoin(broadcast_if_small(ids, MOST_QUERIES))
    rest = first.join(best.select("query_id", *KEY), ["query_id", *KEY], "left_anti").withColumn("score", F.lit(0.0))
    return _ranked(best.select("query_id", *KEY, "score").unionByName(rest.select("query_id", *KEY, "score")), k, "score", "bm25_rank")


def knn(corpus: DataFrame, queries: DataFrame, k: int = CANDIDATES, dim: int = 64, block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, doc_id, chunk_index, score, knn_rank``: the exact k nearest chunks by cosine; score is (1 + cosine) / 2.

    ``queries`` has query_id and vector, ``corpus`` one row per key with embedding, both filtered before.
    Vectors that are null, of another length, not finite or all zero take no part. Query vectors are counted
    and taken in blocks of at most about ``block``: each travels to the tasks as one packed matrix, and every
    task sends on only the k best of each query. Lists of several blocks are stored one after the other, so
    the driver holds one block at a time; the work is that of all queries against all rows.
    """
    from notelake.functions.vectors import usable

    kind = queries.schema["query_id"].dataType.simpleString()
    asked = queries.filter(usable("vector", dim)).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    blocks = spread(asked.count(), block, 1)
    rows = corpus.filter(usable("embedding", dim)).select(*KEY, "embedding")
    if blocks == 1:
        return _nearest(rows, asked, k, dim, kind)[0]
    asked, out = cut_lineage(asked), None
    for b in range(blocks):
        found, shared = _nearest(rows, asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b), k, dim, kind)
        found = cut_lineage(found)
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _nearest(rows: DataFrame, asked: DataFrame, k: int, dim: int, kind: str):
    """The k best rows of each of a block of query vectors, and the broadcast that holds these."""
    held = asked.toArrow()
    vectors = held.column("vector").combine_chunks()
    matrix = _unit_rows(vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
    shared = rows.sparkSession.sparkContext.broadcast((held.column("query_id").to_pylist(), matrix))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _best_of(*shared.value, batches, k)

    return _ranked(rows.mapInPandas(search, f"query_id {kind}, doc_id string, chunk_index int, score double"), k, "score", "knn_rank"), shared


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    matrix = matrix.astype(np.float64)
    return matrix / np.sqrt((matrix * matrix).sum(1, keepdims=True)) if len(matrix) else matrix


def _best_of(names: list, wanted: np.ndarray, batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """The k best rows of the batches (key and embedding) for each of the named vectors."""
    best: list[list[tuple]] = [[] for _ in names]
    for batch in batches:
        if not len(batch):
            continue
        x = _unit_rows(np.stack(batch["embedding"].to_numpy()))
        docs, chunk = batch["doc_id"].to_numpy(), batch["chunk_index"].to_numpy()
        for a in range(0, len(names), VECTOR_BLOCK):
            near = np.round((1 + wanted[a : a + VECTOR_BLOCK] @ x.T) / 2, DIGITS)
            least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k] if near.shape[1] > k else np.full(len(near), -1.0)
            for i, row in enumerate(near, a):
                bound = max(least[i - a], -best[i][-1][0]) if len(best[i]) == k else least[i - a]
                fresh = [(-row[j], docs[j], int(chunk[j])) for j in np.flatnonzero(row >= bound)]
                if fresh:
                    best[i] = sorted(best[i] + fresh)[:k]
    rows = [(n, d, c, -s) for n, own in zip(names, best, strict=True) for s, d, c in own]
    yield pd.DataFrame(rows, columns=["query_id", "doc_id", "chunk_index", "score"])


def rrf(bm25_list: DataFrame, knn_list: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """``query_id, doc_id, chunk_index, score, bm25_rank, knn_rank, rank``: all chunks of both lists by the sum of 1 / (rrf_k + rank).

    Ties keep the lexical order, then the vector order.
    """
    both = bm25_list.select("query_id", *KEY, F.col("bm25_rank"), F.lit(None).cast("int").alias("knn_rank")).unionByName(
        knn_list.select("query_id", *KEY, F.lit(None).cast("int").alias("bm25_rank"), F.col("knn_rank")))
    fused = both.groupBy("query_id", *KEY).agg(F.min("bm25_rank").alias("bm25_rank"), F.min("knn_rank").alias("knn_rank"))
    share = [F.coalesce(1.0 / (F.lit(rrf_k) + F.col(c)), F.lit(0.0)) for c in ("bm25_rank", "knn_rank")]
    scored = fused.withColumn("score", F.round(share[0] + share[1], 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("knn_rank"), *KEY)
    return scored.withColumn("rank", F.row_number().over(order))


def rrf_gap(fused: DataFrame) -> DataFrame:
    """``query_id, candidate_count, rrf_top_gap``: the score of the first less that of the second, 0 if there are fewer than two."""
    first, second = (F.max(F.when(F.col("rank") == r, F.col("score"))) for r in (1, 2))
    return fused.groupBy("query_id").agg(F.count("*").alias("candidate_count"), F.round(F.coalesce(first - second, F.lit(0.0)), DIGITS).alias("rrf_top_gap"))


def native_fusion(bm25_list: DataFrame, knn_list: DataFrame, size: int = TOP_K) -> DataFrame:
    """``query_id, doc_id, chunk_index, score, rank``: lexical and vector score added, a missing one counting 0."""
    both = bm25_list.select("query_id", *KEY, "score").unionByName(knn_list.select("query_id", *KEY, "score"))
    return _ranked(both.groupBy("query_id", *KEY).agg(F.round(F.sum("score"), DIGITS).alias("score")), size, "score", "rank")


def overlap_score(query: Column | str, content: Column | str) -> Column:
    """Share of the distinct query tokens that the content holds: the offline stand-in for a cross-encoder."""
    asked = F.array_distinct(tx.tokens(query))
    return F.round(F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, tx.tokens(content))) / F.size(asked)).otherwise(0.0), DIGITS)


def rerank(candidates: DataFrame, score: Column, top_k: int = TOP_K) -> DataFrame:
    """``candidates`` (with query_id, key and rank) with rerank_score and its new rank; ties keep the order they came in."""
    scored = candidates.withColumn("rerank_score", score).withColumnRenamed("rank", "first_rank")
    return _ranked(scored, top_k, "rerank_score", "rank", ["first_rank"])


def neighbours(hits: DataFrame, corpus: DataFrame, window: int = 1, most_hits: int | None = None) -> DataFrame:
    """``hits`` with neighbours array<struct<chunk_index, section_path, content>>: chunks around each hit, itself left out.

    Archived chunks count. The slots looked for are listed, so the join is on equal keys; they are
    broadcast if ``most_hits``, a limit of the number of hits known to the caller, says they are few. Hits
    without neighbours, or without a key, get an empty list.
    """
    keys = hits.select(*KEY).distinct().filter("doc_id is not null and chunk_index is not null")
    around = F.sequence(F.greatest(F.col("chunk_index") - window, F.lit(0)), F.col("chunk_index") + window)
    slots = keys.select("doc_id", F.col("chunk_index").alias("hit_index"), F.explode(around).alias("chunk_index")).filter("chunk_index <> hit_index")
    slots = slots if most_hits is None else broadcast_if_bounded(slots, most_hits * 2 * window, MOST_TERMS)
    found = corpus.select(*KEY, "section_path", "content").join(slots, KEY)
    lists = found.groupBy("doc_id", "hit_index").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "section_path", "content"))).alias("neighbours"))
    joined = hits.join(lists.withColumnRenamed("hit_index", "chunk_index"), KEY, "left")
    empty = F.array().cast("array<struct<chunk_index:int,section_path:string,content:string>>")
    return joined.withColumn("neighbours", F.coalesce("neighbours", empty))


def hybrid_search(corpus: DataFrame, queries: DataFrame, vectors: DataFrame, visible: Column | None = None, top_k: int = TOP_K, candidate_k: int = CANDIDATES,
                  fusion: str = "rrf", reranked: bool = True, pad: bool = False, dim: int = 64, query_id: str = "id", query: str = "query", index=None) -> DataFrame:
    """``query_id, doc_id, chunk_index, score, rank`` (and rerank_score): the whole search for a batch of queries.

    With an ``index`` (operators.index) built of the corpus, lexical scores come from its postings.

    ``corpus`` has one row per key; ``visible`` says which rows may be returned. ``vectors`` has query_id and
    vector. With ``fusion`` 'native' both scores are added instead of fused by rank.
    """
    shown = corpus if visible is None else corpus.filter(visible)
    fetch = candidate_k if reranked or fusion == "rrf" else top_k
    allowed = None if visible is None else shown.select(*KEY)
    scores = index.bm25(queries, query_id=query_id, query=query) if index else None
    lexical = bm25_topk(corpus, queries, fetch, allowed=allowed, pad=pad, query_id=query_id, query=query, scores=scores)
    vector = knn(shown, vectors, fetch, dim)
    if fusion == "native":
        fused = native_fusion(lexical, vector, fetch).withColumn("rrf_score", F.col("score"))
    else:
        fused = rrf(lexical, vector).filter(F.col("rank") <= fetch)
    fused = fused.select("query_id", *KEY, "score", "rank")
    if not reranked:
        return fused.filter(F.col("rank") <= top_k)
    return reranked_hits(corpus, queries, fused, fetch, top_k, query_id, query)


def reranked_hits(corpus: DataFrame, queries: DataFrame, fused: DataFrame, fetch: int = CANDIDATES, top_k: int = TOP_K, query_id: str = "id", query: str = "query") -> DataFrame:
    """``query_id, doc_id, chunk_index, score, rerank_score, rank``: the best of the fused candidates, at most ``fetch`` of each list, by their texts."""
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query).alias("_query")).dropDuplicates(["query_id"])
    hits = broadcast_if_bounded(fused, queries.count() * 2 * fetch, MOST_TERMS)
    texts = corpus.select(*KEY, "content").join(hits, KEY).join(broadcast_if_small(asked, MOST_QUERIES), "query_id")
    return rerank(texts, overlap_score("_query", "content"), top_k).select("query_id", *KEY, "score", "rerank_score", "rank")


def format_hits(hits: DataFrame) -> DataFrame:
    """``query_id, rank, line``: one line of text per hit (needs title, section_path, category, source_path, content and a score)."""
    shown = F.coalesce("rerank_score", "score") if "rerank_score" in hits.columns else F.col("score")
    head = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit(" | "), F.col("source_path"), F.lit(" #"), F.col("chunk_index").cast("string"),
        F.lit(" | score "), F.format_string("%.3f", shown), F.lit(" | "), F.coalesce("category", F.lit("")),
        F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit(" | "), F.col("title"))).otherwise(""), F.lit("]"),
    )
    section = F.when(F.coalesce("section_path", F.lit("")) != "", F.concat(F.lit("\n"), F.col("section_path"))).otherwise("")
    return hits.select("query_id", "rank", F.concat(head, section, F.lit("\n"), F.substring("content", 1, 300)).alias("line"))

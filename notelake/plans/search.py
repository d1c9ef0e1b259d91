"""Queries over the retrieval operators: the golden queries against all chunks."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions.vectors import hashed_embedding, norm
from notelake.operators import retrieval as rt
from notelake.operators.index import SearchIndex
from notelake.operators.store import is_visible
from notelake.plans.registry import CUR, NOW, VISIBLE, query, sql_tokens
from notelake.plans.storage import chunks
from notelake.runtime import local_folder, table

DIM = 64


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "golden").select("id", "query", "category")


def golden_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden(spark, sf_dir).select(F.col("id").alias("query_id"), hashed_embedding("query", DIM).alias("vector"))


def concept_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of vector searches: every concept whose id is divisible by 50."""
    return table(spark, sf_dir, "concepts").filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))


def _usable(c: str) -> str:
    return f"(len({c}) = {DIM} AND len(list_filter({c}, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter({c}, lambda x: x <> 0)) > 0)"


def _bm25(fields: dict[str, float], name: str = "scores") -> str:
    """CTEs that score all chunks; ``name`` has query_id, doc_id, chunk_index, score."""
    texts = " UNION ALL ".join(f"SELECT '{f}' AS field, {w} AS boost, doc_id, chunk_index, {sql_tokens(f)} AS toks FROM cur" for f, w in fields.items())
    return f"""texts AS ({texts}),
st AS (SELECT field, count(*) AS docs, avg(len(toks)) AS avgdl FROM texts WHERE len(toks) > 0 GROUP BY field),
tok AS (SELECT field, boost, doc_id, chunk_index, len(toks) AS dl, unnest(toks) AS term FROM texts),
qt AS (SELECT query_id, term, count(*) AS n FROM (SELECT id AS query_id, unnest({sql_tokens('query')}) AS term FROM golden) GROUP BY ALL),
post AS (SELECT field, boost, doc_id, chunk_index, dl, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM post GROUP BY ALL),
{name} AS (SELECT query_id, doc_id, chunk_index, round(sum(n * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) * boost), 6) AS score
  FROM post JOIN df USING (field, term) JOIN st USING (field) JOIN qt USING (term) GROUP BY ALL)"""


_VIS = f"vis AS (SELECT * FROM cur WHERE {VISIBLE})"


def _top(source: str, name: str, rank: str, k: int, ties: str = "doc_id, chunk_index") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {ties}) AS INTEGER) AS {rank} FROM {source}) WHERE {rank} <= {k})"""


_VISIBLE_SCORES = "vs AS (SELECT s.* FROM scores s SEMI JOIN vis USING (doc_id, chunk_index))"
_LEXICAL = f"{CUR}, {_VIS}, {_bm25(rt.FIELDS)}, {_VISIBLE_SCORES}, {_top('vs', 'lex', 'bm25_rank', rt.CANDIDATES)}"

#: The hashed embedding of the golden queries, cell by cell.
_QUERY_VECTORS = f"""qtok AS (SELECT id AS query_id, md5(unnest({sql_tokens('query')})) AS m FROM golden),
cells AS (SELECT query_id, ((instr('0123456789abcdef', m[3]) - 1) * 16 + instr('0123456789abcdef', m[4]) - 1) % {DIM} AS c,
  CASE WHEN (instr('0123456789abcdef', m[5]) - 1) % 2 = 0 THEN 1.0 ELSE -1.0 END AS s FROM qtok),
sums AS (SELECT query_id, c, sum(s) AS s FROM cells GROUP BY ALL),
qv AS (SELECT g.query_id, list(coalesce(s, 0)::DOUBLE ORDER BY i) AS vector FROM (SELECT DISTINCT id AS query_id FROM golden) g CROSS JOIN range({DIM}) r(i)
  LEFT JOIN sums ON sums.query_id = g.query_id AND sums.c = r.i GROUP BY g.query_id)"""

_KNN = f"""near AS (SELECT query_id, doc_id, chunk_index, round((1 + list_cosine_similarity(vector, embedding::DOUBLE[])) / 2, 6) AS score
  FROM (SELECT * FROM qv WHERE {_usable('vector')}) q, (SELECT * FROM vis WHERE {_usable('embedding')}) v)"""
_VECTOR = f"{_QUERY_VECTORS}, {_KNN}, {_top('near', 'vec', 'knn_rank', rt.CANDIDATES)}"

_RRF = f"""{_LEXICAL}, {_VECTOR},
fused AS (SELECT query_id, doc_id, chunk_index, bm25_rank, knn_rank, round(coalesce(1.0::DOUBLE / (60 + bm25_rank), 0) + coalesce(1.0::DOUBLE / (60 + knn_rank), 0), 9) AS score
  FROM lex FULL JOIN vec USING (query_id, doc_id, chunk_index)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bm25_rank NULLS LAST, knn_rank NULLS LAST, doc_id, chunk_index) AS INTEGER) AS rank FROM fused)"""

_HYBRID = f"""{_RRF}, cand AS (SELECT * FROM ranked WHERE rank <= {rt.CANDIDATES}),
over AS (SELECT cand.query_id, doc_id, chunk_index, cand.score, rank AS first_rank, list_distinct({sql_tokens('g.query')}) AS a, {sql_tokens('cur.content')} AS b
  FROM cand JOIN cur USING (doc_id, chunk_index) JOIN (SELECT DISTINCT id AS query_id, query FROM golden) g USING (query_id)),
rr AS (SELECT *, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(a) ELSE 0 END, 6) AS rerank_score FROM over),
hits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, first_rank) AS INTEGER) AS rank FROM rr) WHERE rank <= {rt.TOP_K})"""


_FOLDERS: dict[str, str] = {}


def index_of(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The stored index of the chunks below ``sf_dir``: built when first asked for, then read, as long as the files stay the same."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/chunks.parquet")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    state = ",".join(sorted(f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}" for s in system.listStatus(path)))
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.applicationId not in _FOLDERS:
        _FOLDERS[spark.sparkContext.applicationId] = local_folder(spark, "notelake-index-")
    root = shared.rstrip("/") if shared else _FOLDERS[spark.sparkContext.applicationId]
    index = SearchIndex(spark, f"{root}/search-index-{hashlib.md5(f'{sf_dir}|{state}'.encode()).hexdigest()}", dim=DIM)
    return index if index.exists() else index.build(chunks(spark, sf_dir))


def _lexical(spark: SparkSession, corpus: DataFrame, sf_dir: str) -> DataFrame:
    """The lexical list of the golden queries, from the stored index."""
    scores = index_of(spark, sf_dir).bm25(golden(spark, sf_dir))
    return rt.bm25_topk(corpus, golden(spark, sf_dir), allowed=corpus.filter(is_visible(NOW)).select("doc_id", "chunk_index"), scores=scores)


def _vector(spark: SparkSession, corpus: DataFrame, sf_dir: str) -> DataFrame:
    """The vector list of the golden queries."""
    return rt.knn(corpus.filter(is_visible(NOW)), golden_vectors(spark, sf_dir))


def _few(spark: SparkSession, sf_dir: str, hits: DataFrame) -> DataFrame:
    """Hits of the golden queries, at most CANDIDATES of each, for a broadcast."""
    return rt.broadcast_if_bounded(hits, golden(spark, sf_dir).count() * rt.CANDIDATES, rt.MOST_TERMS)


def _searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.hybrid_search(chunks(spark, sf_dir), golden(spark, sf_dir), golden_vectors(spark, sf_dir), is_visible(NOW), index=index_of(spark, sf_dir))


@query(f"WITH {CUR}, {_bm25(rt.FIELDS)} SELECT field, docs, round(avgdl, 6) AS avgdl FROM st")
def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the stored index; the first query that needs the index of a folder builds it."""
    return index_of(spark, sf_dir).statistics().select("field", "docs", F.round("avgdl", 6).alias("avgdl"))


@query()
def knn_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What knn_topk finds, from the clusters of the stored index: approximate, its recall is measured in the README."""
    return index_of(spark, sf_dir).knn(concept_vectors(spark, sf_dir), 10)


@query(f"WITH {CUR}, {_bm25({'content': 1.0})}, {_top('scores', 'best', 'rank', rt.CANDIDATES)} SELECT query_id, doc_id, chunk_index, score, rank FROM best")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = rt.bm25_topk(chunks(spark, sf_dir), golden(spark, sf_dir), fields={"content": 1.0})
    return best.withColumnRenamed("bm25_rank", "rank")


@query(f"WITH {_LEXICAL} SELECT query_id, doc_id, chunk_index, score, bm25_rank FROM lex")
def bm25_multifield(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, chunks(spark, sf_dir), sf_dir)


@query(f"""WITH {CUR}, {_bm25(rt.FIELDS)}, gc AS (SELECT DISTINCT id AS query_id, category FROM golden WHERE category IS NOT NULL),
al AS (SELECT query_id, doc_id, chunk_index FROM gc JOIN cur USING (category) WHERE {VISIBLE}),
padded AS (SELECT query_id, doc_id, chunk_index, coalesce(score, 0.0) AS score FROM al LEFT JOIN scores USING (query_id, doc_id, chunk_index)),
{_top('padded', 'best', 'bm25_rank', 100)} SELECT query_id, doc_id, chunk_index, score, bm25_rank FROM best""")
def bm25_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query within its own category, filled up with chunks that match nothing."""
    corpus, queries = chunks(spark, sf_dir), golden(spark, sf_dir)
    wanted = queries.filter("category is not null").select(F.col("id").alias("query_id"), "category").distinct()
    allowed = corpus.filter(is_visible(NOW)).select("doc_id", "chunk_index", "category").join(rt.broadcast_if_small(wanted, rt.MOST_QUERIES), "category").drop("category")
    return rt.bm25_topk(corpus, queries, 100, allowed=allowed, pad=True)


_CONCEPT_KNN = f"""qv AS (SELECT id AS query_id, embedding::DOUBLE[] AS vector FROM concepts WHERE id % 50 = 0),
near AS (SELECT query_id, doc_id, chunk_index, round((1 + list_cosine_similarity(vector, embedding::DOUBLE[])) / 2, 6) AS score
  FROM (SELECT * FROM qv WHERE {_usable('vector')}) q, (SELECT * FROM base WHERE {_usable('embedding')}) v), {_top('near', 'best', 'knn_rank', 10)}"""


@query(f"WITH {CUR}, base AS (SELECT * FROM cur), {_CONCEPT_KNN} SELECT query_id, doc_id, chunk_index, score, knn_rank FROM best")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.knn(chunks(spark, sf_dir), concept_vectors(spark, sf_dir), 10)


@query(f"WITH {CUR}, base AS (SELECT * FROM cur WHERE category = 'study' AND {VISIBLE}), {_CONCEPT_KNN} SELECT query_id, doc_id, chunk_index, score, knn_rank FROM best")
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = chunks(spark, sf_dir).filter(is_visible(NOW) & (F.col("category") == "study"))
    return rt.knn(shown, concept_vectors(spark, sf_dir), 10)


@query(f"WITH {_RRF} SELECT query_id, doc_id, chunk_index, score, bm25_rank, knn_rank, rank FROM ranked")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = chunks(spark, sf_dir)
    return rt.rrf(_lexical(spark, corpus, sf_dir), _vector(spark, corpus, sf_dir))


@query(f"""WITH {_RRF} SELECT query_id, count(*) AS candidate_count,
round(coalesce(max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END), 0), 6) AS rrf_top_gap FROM ranked GROUP BY query_id""")
def rrf_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.rrf_gap(rrf_fusion(spark, sf_dir))


@query(f"""WITH {_LEXICAL}, {_VECTOR}, su AS (SELECT query_id, doc_id, chunk_index, round(sum(score), 6) AS score
  FROM (SELECT query_id, doc_id, chunk_index, score FROM lex UNION ALL SELECT query_id, doc_id, chunk_index, score FROM vec) GROUP BY ALL), {_top('su', 'best', 'rank', rt.TOP_K)}
SELECT query_id, doc_id, chunk_index, score, rank FROM best""")
def native_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = chunks(spark, sf_dir)
    return rt.native_fusion(_lexical(spark, corpus, sf_dir), _vector(spark, corpus, sf_dir))


@query(f"""WITH {_LEXICAL}, over AS (SELECT lex.query_id, doc_id, chunk_index, bm25_rank, list_distinct({sql_tokens('g.query')}) AS a, {sql_tokens('cur.content')} AS b
  FROM lex JOIN cur USING (doc_id, chunk_index) JOIN (SELECT DISTINCT id AS query_id, query FROM golden) g USING (query_id)),
rr AS (SELECT *, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(a) ELSE 0 END, 6) AS score FROM over), {_top('rr', 'best', 'rank', rt.TOP_K, 'bm25_rank')}
SELECT query_id, doc_id, chunk_index, score AS rerank_score, rank FROM best""")
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = chunks(spark, sf_dir)
    lexical = _lexical(spark, corpus, sf_dir)
    texts = corpus.select("doc_id", "chunk_index", "content").join(_few(spark, sf_dir, lexical), ["doc_id", "chunk_index"])
    asked = golden(spark, sf_dir).select(F.col("id").alias("query_id"), "query").distinct()
    candidates = texts.join(rt.broadcast_if_small(asked, rt.MOST_QUERIES), "query_id").withColumnRenamed("bm25_rank", "rank")
    best = rt.rerank(candidates, rt.overlap_score("query", "content"))
    return best.select("query_id", "doc_id", "chunk_index", "rerank_score", "rank")


@query(f"""WITH {_LEXICAL}, hit AS (SELECT query_id, doc_id, chunk_index FROM lex WHERE bm25_rank <= 5)
SELECT hit.query_id, hit.doc_id, hit.chunk_index, count(c.chunk_index) AS neighbours, coalesce(string_agg(c.chunk_index::VARCHAR || ':' || md5(c.content), ',' ORDER BY c.chunk_index), '') AS digest
FROM hit LEFT JOIN cur c ON c.doc_id = hit.doc_id AND c.chunk_index BETWEEN hit.chunk_index - 2 AND hit.chunk_index + 2 AND c.chunk_index <> hit.chunk_index GROUP BY ALL""")
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = chunks(spark, sf_dir)
    lexical = _lexical(spark, corpus, sf_dir)
    hits = lexical.filter("bm25_rank <= 5").select("query_id", "doc_id", "chunk_index")
    out = rt.neighbours(hits, corpus, 2, golden(spark, sf_dir).count() * 5)
    digest = F.array_join(F.transform("neighbours", lambda n: F.concat(n["chunk_index"].cast("string"), F.lit(":"), F.md5(n["content"]))), ",")
    return out.select("query_id", "doc_id", "chunk_index", F.size("neighbours").cast("bigint").alias("neighbours"), digest.alias("digest"))


@query(f"WITH {_HYBRID} SELECT query_id, doc_id, chunk_index, score, rerank_score, rank FROM hits")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir)


@query(f"""WITH {_HYBRID} SELECT query_id, rank, '[' || rank || ' | ' || source_path || ' #' || chunk_index || ' | score ' || printf('%.3f', rerank_score + 1e-9) || ' | ' || coalesce(category, '')
|| CASE WHEN coalesce(title, '') <> '' THEN ' | ' || title ELSE '' END || ']' || CASE WHEN coalesce(section_path, '') <> '' THEN chr(10) || section_path ELSE '' END || chr(10) || substring(content, 1, 300) AS line
FROM hits JOIN cur USING (doc_id, chunk_index)""")
def format_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _few(spark, sf_dir, _searched(spark, sf_dir))
    corpus = chunks(spark, sf_dir).select("doc_id", "chunk_index", "source_path", "category", "title", "section_path", "content")
    return rt.format_hits(corpus.join(hits, ["doc_id", "chunk_index"]))


@query(f"WITH {_QUERY_VECTORS} SELECT query_id AS id, len(vector) AS dim, round(sqrt(list_sum([x * x for x in vector])), 6) AS length FROM qv")
def embed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = golden_vectors(spark, sf_dir).distinct()
    return docs.select(F.col("query_id").alias("id"), F.size("vector").cast("bigint").alias("dim"), F.round(norm("vector"), 6).alias("length"))

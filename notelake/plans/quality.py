"""Queries over the evaluation operators: rankings against the golden set, and the search log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.operators import evaluate as ev
from notelake.plans import search as se
from notelake.plans.registry import query
from notelake.runtime import cut_lineage, table

_REL = """rx AS (SELECT id AS query_id, unnest(relevant) AS r, generate_subscripts(relevant, 1) AS pos FROM golden),
rel AS (SELECT query_id, r.doc_id AS doc_id, arg_max(coalesce(r.grade, 1), pos) AS grade FROM rx WHERE r.doc_id IS NOT NULL AND r.doc_id <> '' GROUP BY ALL)"""


def _metrics_sql(ranking: str, name: str = "scored") -> str:
    """CTEs from ``ranking`` (query_id, doc_id, r) to the metrics of every golden query."""
    return f"""fi_{name} AS (SELECT query_id, doc_id, min(r) AS r FROM {ranking} WHERE doc_id IS NOT NULL AND doc_id <> '' GROUP BY ALL),
dd_{name} AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY r, doc_id) AS rank FROM fi_{name}),
gt_{name} AS (SELECT query_id, min(rank) AS f, sum(CASE WHEN rank <= 5 THEN (pow(2.0, grade) - 1) / log2(rank + 1) END) AS dcg FROM dd_{name} JOIN rel USING (query_id, doc_id) GROUP BY 1),
id_{name} AS (SELECT query_id, sum((pow(2.0, grade) - 1) / log2(p + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS p FROM rel) WHERE p <= 5 GROUP BY 1),
{name} AS (SELECT q.query_id, coalesce((f <= 1)::INTEGER, 0) AS hit_at_1, coalesce((f <= 3)::INTEGER, 0) AS hit_at_3, coalesce((f <= 5)::INTEGER, 0) AS hit_at_5,
  round(coalesce(1.0 / f, 0), 6) AS mrr, round(coalesce(CASE WHEN ideal > 0 THEN dcg / ideal END, 0), 6) AS ndcg
  FROM (SELECT DISTINCT id AS query_id FROM golden) q LEFT JOIN gt_{name} USING (query_id) LEFT JOIN id_{name} USING (query_id))"""


#: The fused list of the golden queries, as it is.
_RANKED = f"{se._RRF}, {_REL}, rl AS (SELECT query_id, doc_id, rank AS r FROM ranked)"


def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.relevance_map(table(spark, sf_dir, "golden"))


def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.rrf_fusion(spark, sf_dir).select("query_id", "doc_id", "rank")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "golden").select(F.col("id").alias("query_id"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.metrics(ev.dedupe_ranked(ranking(spark, sf_dir)), relevance(spark, sf_dir), _queries(spark, sf_dir))


@query(f"WITH {_REL} SELECT query_id, doc_id, grade FROM rel")
def relevance_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relevance(spark, sf_dir)


@query(f"WITH {_RANKED}, {_metrics_sql('rl')} SELECT query_id, doc_id, rank FROM dd_scored")
def dedupe_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.dedupe_ranked(ranking(spark, sf_dir))


@query(f"WITH {_RANKED}, {_metrics_sql('rl')} SELECT query_id, ndcg FROM scored")
def eval_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("query_id", "ndcg")


@query(f"WITH {_RANKED}, {_metrics_sql('rl')} SELECT query_id, mrr FROM scored")
def eval_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("query_id", "mrr")


@query(f"WITH {_RANKED}, {_metrics_sql('rl')} SELECT query_id, hit_at_1, hit_at_3, hit_at_5 FROM scored")
def eval_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("query_id", "hit_at_1", "hit_at_3", "hit_at_5")


@query(f"""WITH {se._HYBRID}, {_REL}, rl AS (SELECT query_id, doc_id, rank AS r FROM ranked), rk AS (SELECT query_id, doc_id, rank AS r FROM hits),
{_metrics_sql('rl', 'm1')}, {_metrics_sql('rk', 'm2')}, al AS (SELECT 'rrf' AS mode, * FROM m1 UNION ALL SELECT 'rerank', * FROM m2)
SELECT mode, count(*) AS n, round(avg(hit_at_1), 6) AS hit_at_1, round(avg(hit_at_3), 6) AS hit_at_3, round(avg(hit_at_5), 6) AS hit_at_5, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM al GROUP BY mode""")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of the fused list and of the reranked one."""
    scored = [m.withColumn("mode", F.lit(n)) for n, m in zip(("rrf", "rerank"), _both(spark, sf_dir), strict=True)]
    return ev.summary(scored[0].unionByName(scored[1]))


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Metrics of the golden queries by the fused list and by the reranked one; the lists, at most some dozen rows a query, are stored once."""
    corpus, queries = se.chunks(spark, sf_dir), se.golden(spark, sf_dir)
    fused = cut_lineage(se.rt.rrf(se._lexical(spark, corpus, sf_dir), se._vector(spark, corpus, sf_dir)).select("query_id", "doc_id", "chunk_index", "score", "rank"))
    hits = se.rt.reranked_hits(corpus, queries, fused.filter(F.col("rank") <= se.rt.CANDIDATES))
    rel = cut_lineage(relevance(spark, sf_dir))
    return tuple(ev.metrics(ev.dedupe_ranked(r.select("query_id", "doc_id", "rank")), rel, _queries(spark, sf_dir)) for r in (fused, hits))


_LOG = "lg AS (SELECT DISTINCT ts, query, category, top_k, fusion, reranked, latency_ms['total_ms'] AS total_ms, results FROM search_log)"
_GAP = "round(CASE WHEN len(results) >= 2 THEN results[1].score - results[2].score ELSE 0 END, 6)"


@query(f"""WITH {_LOG}, g AS (SELECT fusion, {_GAP} AS gap FROM lg WHERE NOT reranked), o AS (SELECT fusion, list_sort(list(gap)) AS l, count(*) AS n FROM g GROUP BY 1)
SELECT fusion, n, l[1] AS gap_min, l[n // 4 + 1] AS p25, l[n // 2 + 1] AS p50, l[3 * n // 4 + 1] AS p75, l[n] AS gap_max FROM o""")
def gap_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.gap_quartiles(table(spark, sf_dir, "search_log"))


_PAIRS = f"""{_LOG}, sd AS (SELECT query, reranked, arg_min(results, (ts, coalesce(category, ''), fusion, total_ms)) AS results, median(total_ms) AS ms FROM lg WHERE query IS NOT NULL GROUP BY ALL),
pr AS (SELECT a.query, a.results AS ra, b.results AS rb, round(a.ms, 6) AS off_ms, round(b.ms, 6) AS on_ms FROM sd a JOIN sd b USING (query) WHERE NOT a.reranked AND b.reranked),
tr AS (SELECT *, [(x.doc_id, x.chunk_index) for x in ra[1:3]] AS ta, [(x.doc_id, x.chunk_index) for x in rb[1:3]] AS tb FROM pr),
pp AS (SELECT query, round(CASE WHEN len(ra) >= 2 THEN ra[1].score - ra[2].score ELSE 0 END, 6) AS gap, ta[1] IS DISTINCT FROM tb[1] AS top1_changed,
  round(CASE WHEN len(tb) > 0 THEN len(list_intersect(ta, tb)) / 3.0 ELSE 0 END, 6) AS top3_overlap, off_ms, on_ms FROM tr)"""


@query(f"WITH {_PAIRS} SELECT query, gap, top1_changed, top3_overlap, off_ms, on_ms FROM pp")
def topk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.paired_runs(table(spark, sf_dir, "search_log"))


@query(f"""WITH {_PAIRS}, t AS (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in ev.THRESHOLDS)}]) AS threshold),
c AS (SELECT threshold, (SELECT count(*) FROM pp) AS n, count(pp.query) AS skip_n, count(*) FILTER (pp.top1_changed) AS wrong_n, avg(on_ms - off_ms) AS save FROM t LEFT JOIN pp ON gap >= threshold GROUP BY 1)
SELECT threshold, skip_n, round(CASE WHEN n > 0 THEN skip_n / n * 100 ELSE 0 END, 4) AS skip_pct, wrong_n, round(CASE WHEN skip_n > 0 THEN wrong_n / skip_n * 100 ELSE 0 END, 4) AS wrong_pct, round(coalesce(save, 0), 4) AS avg_save_ms FROM c""")
def threshold_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.threshold_simulation(ev.paired_runs(table(spark, sf_dir, "search_log")))


_CONFIG = "fusion || CASE WHEN reranked THEN ' + rerank' ELSE '' END"


@query(f"""WITH {se._HYBRID}, {_REL}, rk AS (SELECT query_id, doc_id, rank AS r FROM hits), {_metrics_sql('rk', 'm1')}, rl AS (SELECT query_id, doc_id, rank AS r FROM ranked), {_metrics_sql('rl', 'm2')}, {_LOG},
sc AS (SELECT 'rrf + rerank' AS config, * FROM m1 UNION ALL SELECT 'rrf', * FROM m2),
q AS (SELECT config, count(*) AS n, round(avg(hit_at_1), 6) AS hit_at_1, round(avg(hit_at_3), 6) AS hit_at_3, round(avg(hit_at_5), 6) AS hit_at_5, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM sc GROUP BY 1),
tm AS (SELECT {_CONFIG} AS config, round(median(total_ms), 6) AS ms_med FROM lg GROUP BY 1), rw AS (SELECT * FROM q LEFT JOIN tm USING (config)), b AS (SELECT * FROM rw WHERE config = 'rrf'),
x AS (SELECT rw.*, round(rw.ndcg - b.ndcg, 6) AS d_ndcg, round(rw.mrr - b.mrr, 6) AS d_mrr, round(rw.hit_at_1 - b.hit_at_1, 6) AS d_hit_at_1, round(rw.ms_med - b.ms_med, 6) AS d_ms, CASE WHEN b.ms_med > 0 THEN rw.ms_med / b.ms_med ELSE 0 END AS ratio FROM rw, b)
SELECT * EXCLUDE (ratio), CASE WHEN ratio >= 1.05 THEN printf('%.1fx slower', ratio) WHEN ratio > 0 AND ratio <= 0.95 THEN printf('%.1fx faster', 1 / ratio) ELSE '~same' END AS speed FROM x""")
def bench_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain, reranked = _both(spark, sf_dir)
    scored = reranked.withColumn("config", F.lit("rrf + rerank")).unionByName(plain.withColumn("config", F.lit("rrf")))
    log = ev.flat_log(table(spark, sf_dir, "search_log"))
    config = F.concat("fusion", F.when(F.col("reranked"), F.lit(" + rerank")).otherwise(""))
    return ev.benchmark_matrix(scored, log.select(config.alias("config"), "total_ms"), "rrf")

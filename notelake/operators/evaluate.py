"""Retrieval quality and the analysis of search logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIGITS = 6
# Gaps at which skipping the reranker is simulated.
THRESHOLDS = (0.0001, 0.0005, 0.001, 0.002, 0.003, 0.005, 0.008, 0.01, 0.02, 0.05)
# Latency ratios from which a configuration counts as slower or faster.
SLOWER, FASTER = 1.05, 0.95


def relevance_map(golden: DataFrame, query_id: str = "id") -> DataFrame:
    """``query_id, doc_id, grade``: a missing grade is 1, entries without doc_id are skipped, of repeated documents the last one counts."""
    rows = golden.select(F.col(query_id).alias("query_id"), F.posexplode("relevant").alias("pos", "r"))
    named = rows.select("query_id", "pos", F.col("r.doc_id").alias("doc_id"), F.coalesce("r.grade", F.lit(1)).alias("grade")).filter("doc_id is not null and doc_id <> ''")
    return named.groupBy("query_id", "doc_id").agg(F.max_by("grade", "pos").alias("grade"))


def dedupe_ranked(ranked: DataFrame, rank: str = "rank") -> DataFrame:
    """``query_id, doc_id, rank``: each document at its first place, renumbered from 1; empty ids are dropped."""
    first = ranked.filter("doc_id is not null and doc_id <> ''").groupBy("query_id", "doc_id").agg(F.min(rank).alias("_r"))
    return first.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("_r", "doc_id")).alias("rank"))


def dcg(grade: Column, rank: Column) -> Column:
    return F.sum((F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1))


def metrics(ranked: DataFrame, relevance: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, hit_at_1, hit_at_3, hit_at_5, mrr, ndcg`` for every query in ``queries`` (query_id).

    ``ranked`` has query_id, doc_id, rank with each document once. A document counts as relevant if it is
    listed, whatever its grade. Queries without relevant documents or results get zeros.
    """
    joined = ranked.join(relevance, ["query_id", "doc_id"])
    got = joined.groupBy("query_id").agg(F.min("rank").alias("first"), dcg(F.when(F.col("rank") <= k, F.col("grade")), F.col("rank")).alias("dcg"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id"))
    ideal = relevance.withColumn("place", place).filter(F.col("place") <= k).groupBy("query_id").agg(dcg(F.col("grade"), F.col("place")).alias("ideal"))
    rows = queries.select("query_id").distinct().join(got, "query_id", "left").join(ideal, "query_id", "left")
    hits = {f"hit_at_{n}": F.coalesce((F.col("first") <= n).cast("int"), F.lit(0)) for n in (1, 3, 5)}
    score = F.coalesce(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")), F.lit(0.0))
    return rows.select("query_id", *[c.alias(n) for n, c in hits.items()], F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), DIGITS).alias("mrr"), F.round(score, DIGITS).alias("ndcg"))


def summary(scored: DataFrame, mode: str = "mode") -> DataFrame:
    """Means of the metrics per mode."""
    names = ("hit_at_1", "hit_at_3", "hit_at_5", "mrr", "ndcg")
    return scored.groupBy(mode).agg(F.count("*").alias("n"), *[F.round(F.avg(n), DIGITS).alias(n) for n in names])


# ----------------------------------------------------------------------------- search logs
def flat_log(log: DataFrame) -> DataFrame:
    """Distinct log lines with plain columns: ts, query, category, fusion, reranked, total_ms, results."""
    columns = log.select("ts", "query", "category", "top_k", "fusion", "reranked", F.col("latency_ms")["total_ms"].alias("total_ms"), "results")
    return columns.distinct()


def result_gap(results: Column) -> Column:
    """Score of the first result less that of the second, 0 if there are fewer than two."""
    first, second = (F.get(results, F.lit(i))["score"] for i in (0, 1))
    return F.round(F.when(F.size(results) >= 2, first - second).otherwise(0.0), DIGITS)


def gap_quartiles(log: DataFrame) -> DataFrame:
    """``fusion, n, gap_min, p25, p50, p75, gap_max`` of the gaps of searches without reranker; quartiles are the elements at n // 4, n // 2, 3n // 4.

    Ranks are taken after the rows of equal gaps are counted, so the number of distinct gaps, not of
    searches, bounds what one task sees.
    """
    gaps = flat_log(log).filter("not reranked").select("fusion", result_gap(F.col("results")).alias("gap"))
    counted = gaps.groupBy("fusion", "gap").agg(F.count("*").alias("n"))
    order = Window.partitionBy("fusion").orderBy("gap")
    running = counted.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy("fusion")))

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("upto") > place, F.col("gap")))

    return running.groupBy("fusion").agg(
        F.max("total").alias("n"), F.min("gap").alias("gap_min"), at(F.floor(F.col("total") / 4)).alias("p25"), at(F.floor(F.col("total") / 2)).alias("p50"),
        at(F.floor(F.col("total") * 3 / 4)).alias("p75"), F.max("gap").alias("gap_max"),
    )


def paired_runs(log: DataFrame) -> DataFrame:
    """``query, gap, top1_changed, top3_overlap, off_ms, on_ms``: each query that ran both without and with reranker.

    Results and gap are those of the earliest run of either kind, latencies the medians of all.
    """
    rows = flat_log(log).filter("query is not null").withColumn("_key", F.struct("ts", F.coalesce("category", F.lit("")), "fusion", "total_ms"))

    def side(reranked: bool, name: str) -> DataFrame:
        own = rows.filter(F.col("reranked") == reranked).groupBy("query").agg(F.min_by("results", "_key").alias(f"{name}_results"), F.median("total_ms").alias(f"{name}_ms"))
        return own

    both = side(False, "off").join(side(True, "on"), "query")

    def ids(c: str, n: int) -> Column:
        return F.transform(F.slice(c, 1, n), lambda r: F.struct(r["doc_id"].alias("d"), r["chunk_index"].alias("c")))

    first = [F.get(ids(c, 1), F.lit(0)) for c in ("off_results", "on_results")]
    on3 = ids("on_results", 3)
    shared = F.when(F.size(on3) > 0, F.size(F.array_intersect(ids("off_results", 3), on3)) / 3.0).otherwise(0.0)
    return both.select("query", result_gap(F.col("off_results")).alias("gap"), (~first[0].eqNullSafe(first[1])).alias("top1_changed"), F.round(shared, DIGITS).alias("top3_overlap"),
                       F.round("off_ms", DIGITS).alias("off_ms"), F.round("on_ms", DIGITS).alias("on_ms"))


def threshold_simulation(pairs: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """``threshold, skip_n, skip_pct, wrong_n, wrong_pct, avg_save_ms`` if the reranker were skipped from this gap on.

    Each row is counted under the thresholds it reaches by conditional sums in one pass.
    """
    saved = F.col("on_ms") - F.col("off_ms")
    aggregates = [F.count("*").alias("n")]
    for i, t in enumerate(thresholds):
        over = F.col("gap") >= t
        aggregates += [F.count_if(over).alias(f"s{i}"), F.count_if(over & F.col("top1_changed")).alias(f"w{i}"), F.avg(F.when(over, saved)).alias(f"a{i}")]
    one = pairs.agg(*aggregates)
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"s{i}").alias("skip_n"), F.col(f"w{i}").alias("wrong_n"), F.col(f"a{i}").alias("save")) for i, t in enumerate(thresholds)]))
    flat = one.select("n", rows.alias("r")).select("n", "r.*")

    def share(a: str, b: str) -> Column:
        return F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b) * 100).otherwise(0.0), 4)

    return flat.select("threshold", "skip_n", share("skip_n", "n").alias("skip_pct"), "wrong_n", share("wrong_n", "skip_n").alias("wrong_pct"), F.round(F.coalesce("save", F.lit(0.0)), 4).alias("avg_save_ms"))


def benchmark_matrix(scored: DataFrame, latencies: DataFrame, baseline: str) -> DataFrame:
    """``config, n, hit_at_1, hit_at_3, hit_at_5, mrr, ndcg, ms_med, d_ndcg, d_mrr, d_hit_at_1, d_ms, speed`` against the baseline configuration.

    ``scored`` has config and the metrics, ``latencies`` config and total_ms.
    """
    quality = summary(scored, "config")
    times = latencies.groupBy("config").agg(F.round(F.median("total_ms"), DIGITS).alias("ms_med"))
    rows = quality.join(times, "config", "left")
    base = rows.filter(F.col("config") == baseline).select(*[F.col(c).alias(f"b_{c}") for c in ("ndcg", "mrr", "hit_at_1", "ms_med")])
    both = rows.crossJoin(F.broadcast(base))  # one row
    ratio = F.when(F.col("b_ms_med") > 0, F.col("ms_med") / F.col("b_ms_med")).otherwise(0.0)
    speed = F.when(ratio >= SLOWER, F.concat(F.format_string("%.1f", ratio), F.lit("x slower"))).when((ratio > 0) & (ratio <= FASTER), F.concat(F.format_string("%.1f", 1 / ratio), F.lit("x faster"))).otherwise("~same")
    deltas = [F.round(F.col(c) - F.col(f"b_{c}"), DIGITS).alias(f"d_{n}") for c, n in (("ndcg", "ndcg"), ("mrr", "mrr"), ("hit_at_1", "hit_at_1"), ("ms_med", "ms"))]
    return both.select(*rows.columns, *deltas, speed.alias("speed"))

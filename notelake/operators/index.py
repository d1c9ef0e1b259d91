"""A search index that is stored once and read in parts: postings by term, and vectors by cluster.

``SearchIndex.build`` writes three tables below a folder: ``postings`` (a row per field, term and chunk,
partitioned by a hash of the term and sorted by it), ``statistics`` (documents and mean length per field) and
``vectors`` (partitioned by nearest centroid). A search reads only the partitions, and in them only the row
groups, of the terms and clusters asked for, so its work follows the matches and not the corpus.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions.vectors import usable
from notelake.operators import retrieval as rt
from notelake.operators.store import KEY
from notelake.runtime import broadcast_if_bounded, spread

#: Vectors the centroids are fitted on, about; picked by a hash of the key from the whole table.
SAMPLE = 20_000
#: Postings, and vectors, that a partition holds, about.
PER_BUCKET, PER_CLUSTER = 2_000_000, 2_000
#: Most clusters; beyond it they grow.
MOST_CLUSTERS = 4_096
#: Per cent of the clusters that a search reads unless told otherwise.
PROBED = 45
#: Terms named in the filter of a scan; more are met by a join that reads the whole table.
MOST_NAMED = 2_000


def centroids(sample: np.ndarray, n: int, seed: int = 5, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit vectors by k-means on the sphere."""
    if not len(sample):
        return sample
    chosen = sample[np.random.default_rng(seed).choice(len(sample), max(1, min(n, len(sample))), replace=False)]
    for _ in range(rounds):
        near = (sample @ chosen.T).argmax(1)
        sums = np.zeros_like(chosen)
        np.add.at(sums, near, sample)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        chosen = np.where(size > 0, sums / np.maximum(size, 1e-12), chosen)
    return chosen


class SearchIndex:
    """The index in ``root``, any folder all tasks can write to and read."""

    def __init__(self, spark: SparkSession, root: str, fields: dict[str, float] | None = None, dim: int = 64):
        self.spark, self.root, self.fields, self.dim = spark, root.rstrip("/"), fields or rt.FIELDS, dim

    # ------------------------------------------------------------------ building
    def build(self, corpus: DataFrame) -> SearchIndex:
        """Writes the index of ``corpus`` (one row per key), over what was there."""
        texts = rt.field_texts(corpus, self.fields)
        postings = texts.select("field", *KEY, "dl", F.explode("tokens").alias("term")).groupBy("field", "term", *KEY).agg(F.count("*").cast("int").alias("tf"), F.max("dl").alias("dl"))
        sizes = texts.groupBy("field").agg(F.count("*").alias("docs"), F.sum("dl").alias("total"))
        sizes.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/statistics")
        total = self.spark.read.parquet(f"{self.root}/statistics").agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
        buckets = spread(total, PER_BUCKET, 16)
        placed = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
        placed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").option("parquet.block.size", 4 << 20).partitionBy("bucket").parquet(f"{self.root}/postings")
        kept = corpus.filter(usable("embedding", self.dim)).select(*KEY, "embedding")
        n = kept.count()
        lists = max(1, min(MOST_CLUSTERS, spread(n, PER_CLUSTER)))
        span = 1 << 62
        few = kept.filter(F.shiftrightunsigned(F.xxhash64(*KEY), 2) < F.lit(int(span * min(1.0, SAMPLE / max(1, n))))).select("embedding").toArrow()
        sample = rt._unit_rows(few.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, self.dim))
        middle = centroids(sample, lists)
        shared = self.spark.sparkContext.broadcast(middle)

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    x = rt._unit_rows(np.stack(batch["embedding"].to_numpy()))
                    yield batch.assign(cluster=(x @ shared.value.T).argmax(1).astype(np.int32) if len(shared.value) else np.int32(0))

        clustered = kept.mapInPandas(place, "doc_id string, chunk_index int, embedding array<float>, cluster int")
        # A large cluster is spread over several files by a salt.
        salted = clustered.repartition(max(4, spread(n, 50_000)), "cluster", F.pmod(F.xxhash64(*KEY), F.lit(4)))
        salted.write.mode("overwrite").partitionBy("cluster").parquet(f"{self.root}/vectors")
        shared.destroy()
        self.spark.createDataFrame([(json.dumps({"buckets": buckets, "centroids": middle.tolist()}),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{self.root}/meta")
        return self

    def exists(self) -> bool:
        """Whether a finished index lies in the folder; what is written last tells."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/meta/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def statistics(self) -> DataFrame:
        """``field, docs, avgdl``: texts with at least one token, and their mean number of tokens."""
        return self._table("statistics", "field string, docs bigint, total bigint").select("field", "docs", (F.col("total") / F.col("docs")).alias("avgdl"))

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def _meta(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/meta", wholetext=True).first()[0])

    # ------------------------------------------------------------------ lexical search
    def postings(self, terms: DataFrame, n_terms: int) -> DataFrame:
        """The postings of the terms; up to MOST_NAMED of them are named to the scan with their buckets."""
        table = self._table("postings", "field string, term string, doc_id string, chunk_index int, tf int, dl int, bucket int")
        if n_terms > MOST_NAMED:
            return table.join(broadcast_if_bounded(terms.select("term").distinct(), n_terms, rt.MOST_TERMS), "term", "left_semi")
        buckets = self._meta()["buckets"]
        asked = [(r.term, r.b) for r in terms.select("term", F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("b")).distinct().collect()]
        return table.filter(F.col("bucket").isin(sorted({b for _, b in asked})) & F.col("term").isin([t for t, _ in asked]))

    def bm25(self, queries: DataFrame, k1: float = rt.K1, b: float = rt.B, query_id: str = "id", query: str = "query") -> DataFrame:
        """``query_id, doc_id, chunk_index, score``, as operators.retrieval.bm25 gives it for the corpus the index was built of."""
        terms = rt.query_terms(queries, query_id, query)
        n_terms = terms.count()
        found = self.postings(terms, n_terms)
        sizes = self.statistics()  # a row per field
        weights = F.create_map(*[F.lit(x) for f, w in self.fields.items() for x in (f, float(w))])
        frequent = found.groupBy("field", "term").agg(F.count("*").alias("df")).join(F.broadcast(sizes), "field")
        known = frequent.withColumn("idf", F.log1p((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * weights[F.col("field")])
        asked = known.join(broadcast_if_bounded(terms, n_terms, rt.MOST_TERMS), "term").select("field", "term", "query_id", (F.col("n") * F.col("idf")).alias("weight"), "avgdl")
        scored = found.join(broadcast_if_bounded(asked, n_terms * len(self.fields), rt.MOST_TERMS), ["field", "term"])
        part = F.col("weight") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        return scored.withColumn("part", part).groupBy("query_id", *KEY).agg(F.round(F.sum("part"), rt.DIGITS).alias("score"))

    # ------------------------------------------------------------------ vector search
    def knn(self, queries: DataFrame, k: int = rt.CANDIDATES, probes: int | None = None) -> DataFrame:
        """``query_id, doc_id, chunk_index, score, knn_rank``: the k nearest chunks in the ``probes`` clusters nearest to each query vector.

        Approximate: a neighbour in another cluster is missed. Only the clusters asked for are read; within
        them the ranking is exact. Queries (query_id, vector) meet the rows of their clusters by a join. Few
        probes are enough for queries like the corpus; by default there are PROBED of the clusters, 16 at
        least, which vectors of any kind need for a recall of 0.9.
        """
        middle = np.array(self._meta()["centroids"]).reshape(-1, self.dim)
        probes = probes or max(16, -(-len(middle) * PROBED // 100))
        kind = queries.schema["query_id"].dataType.simpleString()

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch) and len(middle):
                    x = rt._unit_rows(np.stack(batch["vector"].to_numpy()))
                    near = np.argsort(-(x @ middle.T), axis=1)[:, :probes]
                    rows = np.repeat(np.arange(len(x)), near.shape[1])
                    yield pd.DataFrame({"query_id": batch["query_id"].to_numpy()[rows], "unit": [x[i] for i in rows], "cluster": near.ravel().astype(np.int32)})

        asked = queries.filter(usable("vector", self.dim)).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
        sought = asked.mapInPandas(ask, f"query_id {kind}, unit array<double>, cluster int")
        table = self._table("vectors", "doc_id string, chunk_index int, embedding array<float>, cluster int")
        clusters = [r.cluster for r in sought.select("cluster").distinct().collect()]  # at most MOST_CLUSTERS
        rows = table.filter(F.col("cluster").isin(clusters)) if clusters else table.limit(0)

        def compare(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
            if not len(own) or not len(others):
                return pd.DataFrame(columns=["query_id", "doc_id", "chunk_index", "score"])
            return pd.concat(rt._best_of(own["query_id"].tolist(), np.stack(own["unit"].to_numpy()), iter([others]), k))

        # Shares of a cluster, so that none is whole in one task.
        shares = 8
        dealt = rows.withColumn("share", F.pmod(F.xxhash64(*KEY), F.lit(shares)).cast("int"))
        spread_out = sought.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        found = spread_out.groupBy("cluster", "share").cogroup(dealt.groupBy("cluster", "share")).applyInPandas(lambda a, b: compare(a, b), f"query_id {kind}, doc_id string, chunk_index int, score double")
        return rt._ranked(found, k, "score", "knn_rank")

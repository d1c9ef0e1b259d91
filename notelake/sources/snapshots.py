"""Tables that change: rows lie in buckets by a hash of their key, and a change rewrites only the buckets it touches.

Each write adds files beside the old ones and then a manifest that names, for every bucket, the version its
files belong to. The newest manifest is the table. It comes into being by renaming a finished draft to a name
that does not exist, and nothing older is removed before, so a crash at any point leaves the version before
it; a second writer finds the name taken and fails. Readers keep the version they opened. No table format
beyond parquet is needed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class SnapshotTable:
    """A table in ``root`` with folders data/<version>/_b=<bucket> and manifests manifest/<version>.json.

    Files go through the cluster's file system layer, so ``root`` may be any path Spark can write to. With a
    ``key`` column rows are spread over ``buckets``; without one the table has a single bucket.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str | None = None, buckets: int = 64):
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root.rstrip("/"), schema, key, buckets if key else 1

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _children(self, folder: str) -> list[str]:
        fs, path = self._fs()
        at = path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def versions(self) -> list[int]:
        """Finished versions, the oldest first."""
        return sorted(int(name[:-5]) for name in self._children("manifest") if name.endswith(".json") and name[:-5].isdigit())

    def version(self) -> int:
        """Number of the current version, 0 if there is none."""
        return max(self.versions(), default=0)

    def _manifest(self, version: int) -> dict[int, int]:
        """The version that holds the files of each bucket that has any."""
        fs, path = self._fs()
        stream = fs.open(path(f"{self.root}/manifest/{version}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(b): v for b, v in json.loads(text)["buckets"].items()}

    # ------------------------------------------------------------------ buckets
    def bucket(self, key: Column | None = None) -> Column:
        """The bucket of a row, or of a key."""
        if not self.key:
            return F.lit(0)
        return F.pmod(F.xxhash64(F.col(self.key) if key is None else key), F.lit(self.buckets)).cast("int")

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """Buckets that rows with the key column fall into; at most all of them."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    # ------------------------------------------------------------------ reading and writing
    def read(self, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        v = self.version() if version is None else version
        held = self._manifest(v) if v else {}
        wanted = held if buckets is None else {b: held[b] for b in buckets if b in held}
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/data/{v}/_b={b}" for b, v in sorted(wanted.items())])

    def write(self, df: DataFrame, buckets: Iterable[int] | None = None) -> int:
        """Stores ``df`` as the next version and makes it the current one; ``df`` may read the current version.

        With ``buckets`` it holds all rows of these buckets and none of others; the rest of the table stays as
        it is.
        """
        before = self.version()
        new = before + 1
        fs, path = self._fs()
        fs.delete(path(f"{self.root}/data/{new}"), True)  # left over from a write that failed
        df.withColumn("_b", self.bucket()).write.partitionBy("_b").parquet(f"{self.root}/data/{new}")
        kept = {} if buckets is None or not before else {b: v for b, v in self._manifest(before).items() if b not in set(buckets)}
        written = {int(name[3:]): new for name in self._children(f"data/{new}") if name.startswith("_b=") and name[3:].isdigit()}
        if kept.keys() & written.keys():
            raise ValueError("rows of other buckets than those named")
        self._publish(new, kept | written)
        return new

    def _publish(self, version: int, buckets: dict[int, int]) -> None:
        fs, path = self._fs()
        draft, target = path(f"{self.root}/drafts/{uuid.uuid4().hex}.json"), path(f"{self.root}/manifest/{version}.json")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps({"version": version, "buckets": buckets}).encode()))
        stream.close()
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(draft, target):
            raise RuntimeError(f"another writer made version {version} of {self.root}")

    def change(self, buckets: Iterable[int], function: Callable[[DataFrame], DataFrame]) -> int:
        """Replaces the rows of these buckets by what ``function`` makes of them."""
        buckets = list(buckets)
        return self.write(function(self.read(buckets=buckets)), buckets) if buckets else self.version()

    def drop_old(self, keep: int = 2) -> None:
        """Removes all but the last ``keep`` versions, and files none of those names."""
        fs, path = self._fs()
        versions = self.versions()
        gone, kept = versions[:-keep], versions[-keep:]
        used = {v for version in kept for v in self._manifest(version).values()}
        for v in gone:
            fs.delete(path(f"{self.root}/manifest/{v}.json"), False)
        for name in self._children("data"):
            if name.isdigit() and int(name) <= max(versions, default=0) and int(name) not in used:
                fs.delete(path(f"{self.root}/data/{name}"), True)

    def drop(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.root), True)

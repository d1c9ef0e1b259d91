"""The most similar vectors of every vector, by cross-polytope hashing with exact reranking.

Plan, for N vectors and T tables with P probes:

* keys and a hash of each vector (no vector) are grouped once: of copies of a vector only the first
  k + 1 keys take part in the search, the others take the result of their group;
* passes over the scan count the vectors of every hash prefix, level by level, each level only below the
  prefixes that are too large, in full; prefixes held by more than ``cap`` vectors are split by further hash
  levels, so that no bucket grows with N. Their names travel to the tasks while they are few; beyond
  ``most_heavy`` of them counts and buckets are worked out by joins, with the same result;
* each vector travels T * P times, to the buckets of its prefixes; a bucket is one block of matrix
  products, whose k best per vector (with all ties) are kept, exact to the last double;
* the T * P lists of a vector meet by its id, the best k remain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelake.llm.hashing import mix as _mix
from notelake.runtime import broadcast_if_small, cut_lineage, spread

TABLES, PROBES = 3, 2
#: Dimensions looked at by each hash level; a level has twice as many values.
LEVELS = (64, 4, 8, 16, 32, 64)
#: A bucket above this many vectors is split by the next level.
CAP = 6000
#: Up to so many oversized prefixes (8 bytes each) are sent to the tasks; beyond, the buckets come from joins.
MOST_HEAVY = 2_000_000
#: Up to this dimension one BLAS product by the Hadamard matrix is quicker than the fast transform.
DENSE_ORDER = 256
#: A bucket that the last level leaves above this many vectors is searched in blocks of half as many, pair of blocks by pair.
TIGHT = 12_000
#: Numbers of a similarity matrix held at once.
HELD = 8_000_000
DIGITS = 12


def hadamard(d: int) -> np.ndarray:
    """The orthogonal Walsh-Hadamard matrix of order d, a power of two."""
    h = np.ones((1, 1), np.float32)
    while len(h) < d:
        h = np.block([[h, h], [h, -h]])
    return (h / np.sqrt(d)).astype(np.float32)


def fast_hadamard(x: np.ndarray) -> np.ndarray:
    """``x @ hadamard(d)`` by butterflies, d log d steps a row."""
    (n, d), half = x.shape, 1
    while half < d:
        pairs = x.reshape(n, d // (2 * half), 2, half)
        out = np.empty_like(pairs)
        np.add(pairs[:, :, 0], pairs[:, :, 1], out=out[:, :, 0])
        np.subtract(pairs[:, :, 0], pairs[:, :, 1], out=out[:, :, 1])
        x, half = out.reshape(n, d), 2 * half
    return x / np.float32(np.sqrt(d))


def _order(dim: int) -> int:
    return 1 << (dim - 1).bit_length()


class CrossPolytope:
    """Hash codes of unit vectors: pseudo-rotate three times by signs and Hadamard, take the nearest signed axis."""

    def __init__(self, dim: int, tables: int, probes: int, levels: tuple[int, ...], seed: int):
        self.dim, self.tables, self.probes, self.levels, self.d = dim, tables, probes, tuple(min(x, _order(dim)) for x in levels), _order(dim)
        h = hadamard(self.d) if self.d <= DENSE_ORDER else None
        self.rotate = fast_hadamard if h is None else (lambda x: x @ h)
        self.signs = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (tables, len(levels), 3, self.d))

    def _level(self, x: np.ndarray, table: int, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best and second best axis of each row, and how much is lost by taking the second."""
        y = x
        for s in self.signs[table, level]:
            y = self.rotate(y * s)
        y = y[:, : self.levels[level]]
        size = np.abs(y)
        rows = np.arange(len(y))
        first = size.argmax(1)
        best = size[rows, first]
        size[rows, first] = -1
        second = size.argmax(1)
        loss = best * best - size[rows, second] ** 2
        return first * 2 + (y[rows, first] < 0), second * 2 + (y[rows, second] < 0), loss

    def codes(self, unit: np.ndarray, table: int, depth: int | None = None) -> np.ndarray:
        """(probes, rows, depth) codes: the nearest axes, then with the cheapest of the first two levels replaced by its second axis."""
        depth = max(2, depth or len(self.levels))
        x = np.zeros((len(unit), self.d), np.float32)
        x[:, : self.dim] = unit
        parts = [self._level(x, table, level) for level in range(depth)]
        best, second = (np.stack([p[i] for p in parts], 1) for i in (0, 1))
        out = [best]
        # A swap at a deep level rarely matters, as few prefixes are that long: only the first two are swapped.
        swap = np.argsort(np.stack([p[2] for p in parts[:2]], 1), 1)
        rows = np.arange(len(unit))
        for p in range(1, self.probes):
            probe = best.copy()
            for level in (swap[:, p - 1],) if p <= 2 else (0, 1):
                probe[rows, level] = second[rows, level]
            out.append(probe)
        return np.stack(out)

    def prefixes(self, unit: np.ndarray, table: int, kind: np.ndarray, depth: int | None = None) -> np.ndarray:
        """(probes, rows, depth) 64-bit names of the prefix of each length, different by table and kind; at least two levels."""
        codes = self.codes(unit, table, depth).astype(np.uint64)
        name = np.broadcast_to((kind.astype(np.uint64) * np.uint64(4096) + np.uint64(table)), codes.shape[:2]).copy()
        out = np.empty(codes.shape, np.int64)
        for level in range(codes.shape[2]):
            name = _mix(name * np.uint64(131) + codes[:, :, level] + np.uint64(1))
            out[:, :, level] = name.view(np.int64)
        return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of ``dim`` floats of a list column that holds only such rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    wide = x.astype(np.float64)
    wide /= np.abs(wide).max(1, keepdims=True)
    return (wide / np.sqrt((wide * wide).sum(1, keepdims=True))).astype(np.float32)


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """``kind, key, embedding`` rows whose vector has ``dim`` finite numbers, not all zero."""
    finite = "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    return vectors.filter(f"key is not null and size(embedding) = {dim} and {finite} and exists(embedding, x -> x <> 0)")


def _counts(rows: DataFrame, hasher: CrossPolytope, levels: tuple[int, ...], within: np.ndarray | None) -> DataFrame:
    """``level, name, n``: how many vectors have each prefix of these lengths; with ``within`` only those whose next shorter prefix is named there.

    Counts are complete: a task adds up the prefixes it sees and sends all of them.
    """
    shared = None if within is None else rows.sparkSession.sparkContext.broadcast(within)
    deepest = max(levels) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def added() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            names, level, n = (np.concatenate(x) for x in zip(*held, strict=True))
            own, first, at = np.unique(names, return_index=True, return_inverse=True)
            return own, level[first], np.bincount(at, weights=n).astype(np.int64)

        for batch in batches:
            x = _unit(_matrix(batch.column("embedding"), hasher.dim))
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            for t in range(hasher.tables):
                prefixes = hasher.prefixes(x, t, kind, deepest)
                for level in levels:
                    names = prefixes[:, :, level]
                    if shared is not None:
                        names = names[np.isin(prefixes[:, :, level - 1], shared.value)]
                    own, n = np.unique(names, return_counts=True)
                    held.append((own, np.full(len(own), level, np.int32), n))
            if sum(len(h[0]) for h in held) > 1_000_000:
                held[:] = [added()]
                if len(held[0][0]) > 500_000:  # hardly any repeat in this task: send them on
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.pop()], ["name", "level", "n"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in added()], ["name", "level", "n"])

    return rows.select("kind", "embedding").mapInArrow(count, "name bigint, level int, n bigint").groupBy("level", "name").agg(F.sum("n").alias("n"))


def heavy_prefixes(rows: DataFrame, hasher: CrossPolytope, cap: int, tight: int, most: int) -> tuple[np.ndarray, dict[int, int], int] | None:
    """``(split, dense, rows)``: names of all prefixes with more than ``cap`` rows, the size of whole codes with more than ``tight``, and the number of rows.

    The first two levels are counted at once (their prefixes are few by construction), each further one in a
    pass of its own over the rows whose prefix so far is too large; there is none where no prefix is. None if
    there are more than ``most`` names: they are then no longer sent to the tasks.
    """
    last = len(hasher.levels) - 1
    first = cut_lineage(_counts(rows, hasher, (0, 1), None))
    total = first.filter("level = 0").agg(F.sum("n")).first()[0] or 0
    over = first.filter(f"n > {cap if last > 1 else tight}").select("level", "name", "n")
    split, dense, level = [], {}, 1
    while True:
        found = over.limit(most + 1 - sum(map(len, split))).collect()
        if sum(map(len, split)) + len(found) > most:
            return None
        if level == last:
            dense = {r.name: r.n for r in found if r.level == last}
            found = [r for r in found if r.level < last]
        split.append(np.array([r.name for r in found], np.int64))
        parents = np.array([r.name for r in found if r.level == level], np.int64)
        if level == last or not len(parents):
            return np.sort(np.concatenate(split)), dense, total // (hasher.tables * hasher.probes)
        level += 1
        over = _counts(rows, hasher, (level,), np.sort(parents)).filter(f"n > {tight if level == last else cap}")


def _placed_by_join(rows: DataFrame, hasher: CrossPolytope, cap: int, tight: int) -> tuple[DataFrame, int]:
    """``(bucket, id, vector)`` and the number of its rows, without sending any name to the tasks.

    The names of all prefixes of a row are counted on the cluster and met with the oversized ones by a join;
    as a prefix is at least as large as its continuations, the number met is the level to split at.
    """
    last, slots = len(hasher.levels) - 1, hasher.tables * hasher.probes

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_matrix(batch.column("embedding"), hasher.dim))
            ids, kind = batch.column("id"), batch.column("kind").to_numpy(zero_copy_only=False)
            for t in range(hasher.tables):
                for p, names in enumerate(hasher.prefixes(x, t, kind)):
                    lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * (last + 1), pa.array(names.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(x), t * hasher.probes + p, np.int32)), lists], ["id", "slot", "names"])

    named = cut_lineage(rows.select("kind", "id", "embedding").mapInArrow(name, "id bigint, slot int, names array<bigint>"))
    each = named.select("id", "slot", F.posexplode("names").alias("level", "name"))
    sizes = cut_lineage(each.groupBy("level", "name").agg(F.count("*").alias("n")).filter(f"n > {cap} and level < {last} or n > {tight} and level = {last}"))
    depth = each.filter(f"level < {last}").join(sizes.select("level", "name"), ["level", "name"], "left_semi").groupBy("id", "slot").agg(F.count("*").cast("int").alias("depth"))
    at = named.join(depth, ["id", "slot"], "left").select("id", "slot", F.expr("names[coalesce(depth, 0)]").alias("bucket"))
    dense = sizes.filter(f"level = {last}").select(F.col("name").alias("bucket"), F.ceil(F.col("n") * 2 / tight).cast("int").alias("blocks"))
    once = at.groupBy("id", "bucket").agg(F.min("slot").alias("slot")).join(dense, "bucket", "left")
    own = F.pmod("id", "blocks")
    spread_out = once.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0)))))
    place = F.when(F.col("blocks").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", F.least(own, "other"), F.greatest(own, "other")))
    placed = cut_lineage(spread_out.select("id", place.alias("bucket")))
    vector = rows.select("id", F.col("embedding").alias("v"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("id"), pa.array([v.tobytes() for v in _matrix(batch.column("v"), hasher.dim)], pa.binary())], ["bucket", "id", "vector"])

    return placed.join(vector, "id").select("bucket", "id", "v").mapInArrow(packed, "bucket bigint, id bigint, vector binary"), max(placed.count(), slots)


def _best(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, list[bytes]]:
    """For each row of one bucket its k best others, with all ties: packed (id, cosine) pairs."""
    ids, first = np.unique(ids, return_index=True)
    x = x[first]
    n = len(ids)
    if n < 2:
        return ids[:0], []
    unit = _unit(x)
    wide = x.astype(np.float64)
    wide /= np.sqrt((wide * wide).sum(1, keepdims=True))
    packed = []
    block = max(1, min(1024, HELD // n))
    for a in range(0, n, block):
        near = unit[a : a + block] @ unit.T
        rows = np.arange(len(near))
        near[rows, rows + a] = -2
        if n - 1 > k:
            bound = np.partition(near, n - k, axis=1)[:, n - k] - np.float32(2e-6)
        else:
            bound = np.full(len(near), -1.5, np.float32)
        r, c = np.nonzero(near >= bound[:, None])
        keep = c != r + a
        r, c = r[keep], c[keep]
        cos = np.round(np.einsum("ij,ij->i", wide[r + a], wide[c]), DIGITS)
        edges = np.searchsorted(r, np.arange(len(near) + 1))
        for i in range(len(near)):
            own, target = cos[edges[i] : edges[i + 1]], c[edges[i] : edges[i + 1]]
            if len(own) > k:
                least = np.partition(own, len(own) - k)[len(own) - k]
                own, target = own[own >= least], target[own >= least]
            packed.append(ids[target].tobytes() + own.tobytes())
    return ids, packed


def _in_buckets(dim: int, k: int):
    """Reads all rows of a partition (whole buckets, of bounded size) and searches each bucket."""
    schema = pa.schema([("id", pa.int64()), ("best", pa.binary())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, ids, vectors = [], [], []
        for batch in batches:
            buckets.append(batch.column("bucket").to_numpy())
            ids.append(batch.column("id").to_numpy())
            vectors.append(np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.float32).reshape(-1, dim))
        if not buckets:
            return
        bucket, id_, x = np.concatenate(buckets), np.concatenate(ids), np.concatenate(vectors)
        del buckets, ids, vectors
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order])) + 1
        out_ids, out, held = [], [], 0
        for rows in np.split(order, edges):
            if len(rows) < 2:
                continue
            own, best = _best(id_[rows], x[rows], k)
            out_ids.append(own)
            out += best
            held += len(best)
            if held >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_ids)), pa.array(out, pa.binary())], schema=schema)
                out_ids, out, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_ids)), pa.array(out, pa.binary())], schema=schema)

    return search


def _merge(k: int):
    """All lists of an id lie in one partition: different neighbours once, the k best with all ties."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys, cs = [], [], []
        for batch in batches:
            best = batch.column("best").to_pylist()
            n = np.array([len(b) // 16 for b in best])
            xs.append(np.repeat(batch.column("id").to_numpy(), n))
            ys.append(np.frombuffer(b"".join(b[: len(b) // 2] for b in best), np.int64))
            cs.append(np.frombuffer(b"".join(b[len(b) // 2 :] for b in best), np.float64))
        if not xs:
            return
        x, y, c = np.concatenate(xs), np.concatenate(ys), np.concatenate(cs)
        order = np.lexsort((y, -c, x))
        x, y, c = x[order], y[order], c[order]
        fresh = np.ones(len(x), bool)
        fresh[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        x, y, c = x[fresh], y[fresh], c[fresh]
        starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        size = np.diff(np.r_[starts, len(x)])
        place = np.arange(len(x)) - np.repeat(starts, size)
        last = c[np.minimum(starts + k, starts + size) - 1]
        keep = (place < k) | (c >= np.repeat(last, size))
        kept = np.add.reduceat(keep, starts)
        for a in range(0, len(x), 100_000):
            part = slice(a, a + 100_000)
            m = keep[part]
            yield pa.RecordBatch.from_arrays([pa.array(x[part][m]), pa.array(y[part][m]), pa.array(c[part][m]), pa.array(np.repeat(kept, size)[part][m] > k)], ["id", "other", "cosine", "tied"])

    return merge


def most_similar(vectors: DataFrame, k: int = 3, dim: int = 64, tables: int = TABLES, probes: int = PROBES,
                 cap: int = CAP, tight: int = TIGHT, seed: int = 7, rows_per_task: int = 60_000, most_heavy: int = MOST_HEAVY) -> DataFrame:
    """``kind, key, other, cosine``: for each usable vector its k most similar others of the same kind.

    ``vectors`` has kind (int), key (string) and embedding (array<float>). Vectors that are null, of
    another length, not finite or all zero take no part; rows of one key count once. The cosine is
    rounded to 12 digits, ties go to the smaller key. The candidates are those that share a bucket in one
    of the tables, so a few neighbours may be missed; what is returned is ranked exactly. A kind with one
    vector has no rows.

    Ids are 64-bit hashes of (kind, key); at a billion keys a clash of two has a chance of about 3 %.
    """
    spark = vectors.sparkSession
    base = usable(vectors.select(F.col("kind").cast("int").alias("kind"), F.col("key").cast("string").alias("key"), F.col("embedding").cast("array<float>").alias("embedding")), dim)
    id_of = F.xxhash64("kind", "key")
    groups = base.select("kind", "key", F.md5(F.array_join(F.col("embedding").cast("array<string>"), ",")).alias("look"), id_of.alias("id")).dropDuplicates(["id"])

    # Copies: of each look the k + 1 smallest keys search, the rest (only in large groups) take over their result.
    copies = groups.groupBy("kind", "look").agg(F.count("*").alias("n")).filter(f"n > {k + 1}")
    large = copies.limit(1).count() > 0
    rows = base.withColumn("id", id_of)
    extra = None
    if large:
        ranked = groups.join(copies.select("kind", "look"), ["kind", "look"]).withColumn("at", F.row_number().over(Window.partitionBy("kind", "look").orderBy("key")))
        few = ranked.filter(f"at <= {k + 1}")
        last = few.groupBy("kind", "look").agg(F.max("key").alias("last_key"), F.min_by("id", "key").alias("first_id"))
        last = broadcast_if_small(last, 200_000)
        looks = F.md5(F.array_join(F.col("embedding").cast("array<string>"), ","))
        rows = rows.withColumn("look", looks).join(last, ["kind", "look"], "left").filter("last_key is null or key <= last_key").drop("look", "last_key", "first_id")
        extra = groups.join(last, ["kind", "look"]).filter("key > last_key").select("kind", "key", "id", "first_id")

    hasher = CrossPolytope(dim, tables, probes, LEVELS, seed)
    sizes = heavy_prefixes(rows, hasher, cap, tight, most_heavy)
    heavy = None
    if sizes is not None:
        names, dense, total = sizes
        heavy = spark.sparkContext.broadcast((names, dense))
        # Rows of a dense bucket travel once per block of it, and as many lists of each come back.
        copies_sent = total * tables * probes + sum(n * -(-2 * n // tight) for n in dense.values())

    def in_blocks(bucket: np.ndarray, ids: np.ndarray, raw: list[bytes], dense: dict[int, int]) -> Iterator[pa.RecordBatch]:
        """Each row in every pair of blocks with its own one, so that each two rows of the bucket meet."""
        for name in np.unique(bucket).tolist():
            blocks = -(-2 * dense[name] // tight)
            at = np.flatnonzero(bucket == name)
            own = ids[at] % blocks
            for other in range(blocks):
                pair = np.minimum(own, other) * blocks + np.maximum(own, other)
                with np.errstate(over="ignore"):
                    place = _mix(np.int64(name).astype(np.uint64) + _mix(pair.astype(np.uint64) + np.uint64(1))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(ids[at]), pa.array([raw[i] for i in at], pa.binary())], ["bucket", "id", "vector"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, dense = heavy.value
        dense_names = np.array(sorted(dense), np.int64)
        for batch in batches:
            x = _matrix(batch.column("embedding"), dim)
            ids, kind = batch.column("id").to_numpy(), batch.column("kind").to_numpy()
            unit = _unit(x)
            raw = [v.tobytes() for v in x]
            for t in range(tables):
                bucket = hasher.prefixes(unit, t, kind, 2)[:, :, 0].copy()
                open_ = np.isin(bucket, split) if len(split) else np.zeros(bucket.shape, bool)
                deep = np.flatnonzero(open_.any(0))
                if len(deep):  # longer names only of the rows that need them
                    prefixes, own = hasher.prefixes(unit[deep], t, kind[deep]), open_[:, deep]
                    for level in range(1, prefixes.shape[2]):
                        if not own.any():
                            break
                        at, row = np.nonzero(own)
                        bucket[at, deep[row]] = prefixes[at, row, level]
                        own[at, row] = np.isin(prefixes[at, row, level], split)
                for p in range(probes):
                    mine = np.ones(len(x), bool)
                    for q in range(p):
                        mine &= bucket[p] != bucket[q]
                    if len(dense_names):
                        whole = mine & np.isin(bucket[p], dense_names)
                        at = np.flatnonzero(whole)
                        yield from in_blocks(bucket[p][at], ids[at], [raw[i] for i in at], dense)
                        mine &= ~whole
                    at = np.flatnonzero(mine)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[p][at]), pa.array(ids[at]), pa.array([raw[i] for i in at], pa.binary())], ["bucket", "id", "vector"])

    if heavy is None:
        placed, copies_sent = _placed_by_join(rows, hasher, cap, tight)
    else:
        placed = rows.select("kind", "id", "embedding").mapInArrow(place, "bucket bigint, id bigint, vector binary")
    tasks = spread(copies_sent, rows_per_task, 4)
    found = placed.repartition(tasks, "bucket").mapInArrow(_in_buckets(dim, k), "id bigint, best binary")
    merged = found.repartition(spread(copies_sent, rows_per_task * tables * probes, 4), "id").mapInArrow(_merge(k), "id bigint, other bigint, cosine double, tied boolean")

    names_ = groups.select("id", "kind", "key")
    keyed = merged.join(names_.select(F.col("id").alias("other"), F.col("key").alias("other_key")), "other").join(names_, "id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other_key"))
    sure = keyed.filter("not tied")
    best = sure.unionByName(keyed.filter("tied").withColumn("_r", rank).filter(f"_r <= {k}").drop("_r"))
    result = best.select("kind", "key", F.col("other_key").alias("other"), "cosine")
    if extra is not None:
        # A further copy sees its group's k smallest keys and whatever ties with them, as the first of the group does with itself added.
        firsts = keyed.join(extra.select(F.col("first_id").alias("id")).distinct(), "id", "left_semi").select("id", "other_key", "cosine")
        itself = names_.join(extra.select(F.col("first_id").alias("id")).distinct(), "id", "left_semi").select("id", F.col("key").alias("other_key"), F.lit(1.0).alias("cosine"))
        lists = firsts.unionByName(itself).withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other_key"))).filter(f"_r <= {k}").drop("_r")
        more = extra.select("kind", "key", F.col("first_id").alias("id")).join(lists, "id")
        result = result.unionByName(more.select("kind", "key", F.col("other_key").alias("other"), "cosine"))
    return result


def similar_pairs(vectors: DataFrame, k: int = 3, **options) -> DataFrame:
    """``kind, key_a, key_b``: pairs, key_a < key_b, in which at least one is among the k most similar of the other."""
    found = most_similar(vectors, k, **options)
    return found.select("kind", F.least("key", "other").alias("key_a"), F.greatest("key", "other").alias("key_b")).distinct()

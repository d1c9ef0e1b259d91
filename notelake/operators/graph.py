"""The concept graph: entity resolution, edge and mention counts, traversal, export."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelake import schema
from notelake.functions import text as tx
from notelake.functions.vectors import cosine, usable
from notelake.operators.components import connected
from notelake.runtime import broadcast_if_small, cut_lineage, spread

# Fixed value: similarity from which two concepts are one.
SAME_CONCEPT = 0.88
# Tokens a chunk costs, and dollars per million of them.
IN_TOKENS, OUT_TOKENS, IN_PRICE, OUT_PRICE = 1500, 300, 1.0, 5.0
DIGITS = 6
MOST_CONCEPTS = 1_000_000
#: Tasks the edges of one concept are first ranked in.
HUB_SHARES = 16


# ----------------------------------------------------------------------------- look-ups and listings
def concept_lookup(names: DataFrame, concepts: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """``name, slug, concept_id, found_by``: the concept with this slug, else the smallest one with this alias, else null."""
    asked = names.select(F.col(name).alias("name")).distinct().withColumn("slug", tx.slug("name"))
    by_slug = concepts.groupBy("slug").agg(F.min("id").alias("slug_id"))
    by_alias = aliases.groupBy(F.col("alias_slug").alias("slug")).agg(F.min("concept_id").alias("alias_id"))
    found = asked.join(by_slug, "slug", "left").join(by_alias, "slug", "left")
    how = F.when(F.col("slug_id").isNotNull(), "slug").when(F.col("alias_id").isNotNull(), "alias")
    return found.select("name", "slug", F.coalesce("slug_id", "alias_id").alias("concept_id"), how.alias("found_by"))


def _named(edges: DataFrame, concepts: DataFrame, end: str) -> DataFrame:
    names = concepts.select(F.col("id").alias(end), F.col("name").alias("other"))
    return edges.join(names, end)


def list_edges(edges: DataFrame, concepts: DataFrame, direction: str = "out", relation: str | None = None, top_k: int | None = None) -> DataFrame:
    """``concept_id, direction, relation, weight, other_id, other, rank``: edges of each concept, heaviest first, then by name and id.

    With ``top_k`` only the first ones of each concept and direction; 'both' gives either direction its own list.
    """
    if direction == "both":
        return list_edges(edges, concepts, "out", relation, top_k).unionByName(list_edges(edges, concepts, "in", relation, top_k))
    near, far = ("src_id", "dst_id") if direction == "out" else ("dst_id", "src_id")
    rows = edges if relation is None else edges.filter(F.col("relation") == relation)
    named = _named(rows.filter("src_id is not null and dst_id is not null"), concepts, far)
    by = [F.desc_nulls_last("weight"), F.col("other"), F.col(far), F.col("relation")]
    if top_k:
        # First within shares of each concept's edges, so that the edges of a hub are cut down in many tasks.
        share = F.pmod(F.xxhash64(far, "relation"), F.lit(HUB_SHARES))
        named = named.withColumn("_s", share).withColumn("_r", F.row_number().over(Window.partitionBy(near, "_s").orderBy(*by))).filter(F.col("_r") <= top_k).drop("_s", "_r")
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy(near).orderBy(*by)))
    if top_k:
        ranked = ranked.filter(F.col("rank") <= top_k)
    return ranked.select(F.col(near).alias("concept_id"), F.lit(direction).alias("direction"), "relation", "weight", F.col(far).alias("other_id"), "other", "rank")


def two_hop(edges: DataFrame, concepts: DataFrame, start: DataFrame) -> DataFrame:
    """``concept_id, hop, other_id, via_id, relation, weight`` around the concepts in ``start`` (column id).

    Hop 1 are all outbound edges; hop 2 the outbound edges of these neighbours to concepts not yet seen,
    each by its first path: heaviest first edge, then heaviest second one, then ids and relations.
    """
    known = broadcast_if_small(concepts.select(F.col("id").alias("dst_id")), MOST_CONCEPTS)
    out = edges.filter("src_id is not null").join(known, "dst_id", "left_semi").withColumn("w", F.coalesce("weight", F.lit(-1.0)))
    first = out.join(broadcast_if_small(start.select(F.col("id").alias("src_id")).distinct(), MOST_CONCEPTS), "src_id", "left_semi")
    hop1 = first.select(F.col("src_id").alias("concept_id"), F.lit(1).alias("hop"), F.col("dst_id").alias("other_id"), F.lit(None).cast("bigint").alias("via_id"), "relation", "weight")
    best = Window.partitionBy("src_id", "dst_id").orderBy(F.desc("w"), "relation")
    steps = first.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select(F.col("src_id").alias("concept_id"), F.col("dst_id").alias("via_id"), F.col("w").alias("w1"))
    second = out.select(F.col("src_id").alias("via_id"), F.col("dst_id").alias("other_id"), "relation", "weight", F.col("w").alias("w2"))
    paths = second.join(steps, "via_id").filter("other_id <> concept_id").join(hop1.select("concept_id", "other_id").distinct(), ["concept_id", "other_id"], "left_anti")
    # The first path by a minimum, which tasks take before anything is shuffled: paths through a hub never meet in one task.
    first_path = F.min(F.struct((-F.col("w1")).alias("a"), (-F.col("w2")).alias("b"), "via_id", "relation", "weight")).alias("p")
    hop2 = paths.groupBy("concept_id", "other_id").agg(first_path).select("concept_id", F.lit(2).alias("hop"), "other_id", "p.via_id", "p.relation", "p.weight")
    return hop1.unionByName(hop2)


def search_concepts(concepts: DataFrame, queries: DataFrame, top_k: int = 10, dim: int = 64) -> DataFrame:
    """``query_id, concept_id, score, rank``: the concepts with the highest cosine to each query vector (query_id, vector)."""
    from notelake.operators.retrieval import knn

    corpus = concepts.select(F.col("id").cast("string").alias("doc_id"), F.lit(0).alias("chunk_index"), "embedding")
    found = knn(corpus, queries, top_k, dim)
    return found.select("query_id", F.col("doc_id").cast("bigint").alias("concept_id"), F.round(2 * F.col("score") - 1, 5).alias("score"), F.col("knn_rank").alias("rank"))


def similar_concepts(concepts: DataFrame, asked: DataFrame, threshold: float = SAME_CONCEPT, dim: int = 64, block: int = 100_000) -> DataFrame:
    """``concept_id, other_id, cosine``: for the concepts in ``asked`` all others with at least this similarity, exact.

    ``asked`` is counted and taken in blocks: each is broadcast as one packed matrix, which every task
    multiplies with its concepts, sending on only what reaches the threshold. The work is that of all asked
    concepts against all concepts.
    """
    rows = asked.filter(usable("embedding", dim)).select("id", "embedding").distinct()
    n = rows.count()
    blocks = max(1, spread(n, block))
    rows = cut_lineage(rows) if blocks > 1 else rows
    kept = concepts.filter(usable("embedding", dim)).select("id", "embedding")
    out = None
    for b in range(blocks):
        own = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        found, shared = _similar_to(own, kept, threshold, dim)
        if blocks > 1:  # one block on the driver at a time
            found = cut_lineage(found)
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _similar_to(asked: DataFrame, concepts: DataFrame, threshold: float, dim: int):
    held = asked.toArrow()  # one block of vectors
    matrix = held.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    matrix = matrix / np.sqrt((matrix * matrix).sum(1, keepdims=True)) if len(matrix) else matrix
    shared = concepts.sparkSession.sparkContext.broadcast((held.column("id").to_numpy(), matrix))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, wanted = shared.value
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["embedding"].to_numpy()).astype(np.float64)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            own = batch["id"].to_numpy()
            for a in range(0, len(ids), 1024):
                c = np.round(wanted[a : a + 1024] @ x.T, DIGITS)
                i, j = np.nonzero(c >= threshold)
                keep = ids[a + i] != own[j]
                yield pd.DataFrame({"concept_id": ids[a + i][keep], "other_id": own[j][keep], "cosine": c[i, j][keep]})

    return concepts.mapInPandas(compare, "concept_id bigint, other_id bigint, cosine double"), shared


# ----------------------------------------------------------------------------- counts
def accumulate_edges(edges: DataFrame, occurrences: DataFrame) -> DataFrame:
    """``edges`` after each occurrence (src_id, dst_id, relation) added 1 to weight and evidence; loops among the occurrences are dropped."""
    fresh = occurrences.filter("src_id <> dst_id and relation is not null").groupBy("src_id", "dst_id", "relation").agg(F.count("*").alias("n"))
    added = fresh.select("src_id", "dst_id", "relation", F.col("n").cast("double").alias("weight"), F.col("n").alias("evidence_count"))
    both = edges.select(*added.columns).unionByName(added)
    return both.groupBy("src_id", "dst_id", "relation").agg(F.sum("weight").alias("weight"), F.sum("evidence_count").alias("evidence_count"))


def distinct_mentions(mentions: DataFrame) -> DataFrame:
    """One row per (concept, document, chunk), with the first section path in text order."""
    return mentions.groupBy("concept_id", "doc_id", "chunk_index").agg(F.min("section_path").alias("section_path"))


def mention_counts(concepts: DataFrame, mentions: DataFrame) -> DataFrame:
    """``concept_id, mentions, stored``: distinct mentions of each concept beside the stored counter."""
    counts = distinct_mentions(mentions).groupBy("concept_id").agg(F.count("*").alias("mentions"))
    joined = concepts.select(F.col("id").alias("concept_id"), F.col("mention_count").alias("stored")).join(counts, "concept_id", "left")
    return joined.select("concept_id", F.coalesce("mentions", F.lit(0)).alias("mentions"), "stored")


def graph_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """``name, rows`` of each table."""
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in tables.items()]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


def cost_estimate(chunks: DataFrame) -> DataFrame:
    """``category, chunks, input_tokens, output_tokens, dollars`` that extraction would take."""
    counted = chunks.groupBy("category").agg(F.count("*").alias("chunks"))
    price = F.col("input_tokens") / 1e6 * IN_PRICE + F.col("output_tokens") / 1e6 * OUT_PRICE
    return counted.withColumns({"input_tokens": F.col("chunks") * IN_TOKENS, "output_tokens": F.col("chunks") * OUT_TOKENS}).withColumn("dollars", F.round(price, 4))


def graph_run(run_id: int, chunks: DataFrame, concepts: DataFrame, edges: DataFrame, category: str | None, now: str, model: str = "offline", status: str = "done") -> DataFrame:
    """One audit row of a build."""
    n = [df.agg(F.count("*").alias(name)) for df, name in ((chunks, "chunks_processed"), (concepts, "concepts_added"), (edges, "edges_added"))]
    one = n[0].crossJoin(n[1]).crossJoin(n[2])  # one row each
    time = F.to_timestamp(F.lit(now))
    return one.select(F.lit(run_id).cast("bigint").alias("id"), time.alias("started_at"), time.alias("finished_at"), F.lit(category).cast("string").alias("scope_category"), F.lit(None).cast("string").alias("scope_doc_id"),
                      "chunks_processed", "concepts_added", "edges_added", F.lit(model).alias("model"), F.lit(status).alias("status"))


def clear_mentions(mentions: DataFrame, chunks: DataFrame, category: str | None = None, doc_id: str | None = None) -> DataFrame:
    """The mentions left after a rebuild of a scope dropped its own; a document takes precedence over a category."""
    if doc_id:
        return mentions.filter(~F.col("doc_id").eqNullSafe(F.lit(doc_id)))
    if not category:
        raise ValueError("a scope needs a category or a doc_id")
    docs = chunks.filter(F.col("category") == category).select("doc_id").distinct()
    return mentions.join(docs, "doc_id", "left_anti").select(*mentions.columns)


# ----------------------------------------------------------------------------- export
def _exported(concepts: DataFrame, category: str | None) -> DataFrame:
    return concepts if category is None else concepts.filter(F.col("category") == category)


def export_edges(edges: DataFrame, concepts: DataFrame, category: str | None = None, min_weight: float = 1.0) -> DataFrame:
    """Edges of at least this weight with both ends among the exported concepts."""
    ids = broadcast_if_small(_exported(concepts, category).select("id"), MOST_CONCEPTS)
    heavy = edges.filter(F.col("weight") >= min_weight)
    return heavy.join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi").select(*edges.columns)


def _lines(df: DataFrame, part: int, place: Column, line: Column) -> DataFrame:
    return df.select(F.lit(part).alias("part"), place.cast("string").alias("place"), line.alias("line"))


def _place(*columns: str) -> Column:
    """A text that sorts like these columns."""
    return F.concat_ws("|", *[F.format_string("%020d", c) if c.endswith("id") else F.coalesce(F.col(c), F.lit("")) for c in columns])


def export_mermaid(edges: DataFrame, concepts: DataFrame, category: str | None = None, min_weight: float = 1.0) -> DataFrame:
    """``part, place, line``: a left-to-right diagram; sorted by part and place its lines are the head, a node per concept and a link per edge."""
    label = F.translate(F.coalesce("name", F.lit("")), '"', "'")
    node = F.concat(F.lit("  n"), F.col("id").cast("string"), F.lit('["'), label, F.lit('"]'))
    link = F.concat(F.lit("  n"), F.col("src_id").cast("string"), F.lit(" -- "), F.coalesce("relation", F.lit("")), F.lit(" --> n"), F.col("dst_id").cast("string"))
    head = _lines(concepts.sparkSession.range(1), 0, F.lit(""), F.lit("graph LR"))
    return head.unionByName(_lines(_exported(concepts, category), 1, _place("id"), node)).unionByName(_lines(export_edges(edges, concepts, category, min_weight), 2, _place("src_id", "dst_id", "relation"), link))


def export_json(edges: DataFrame, concepts: DataFrame, category: str | None = None, min_weight: float = 1.0) -> DataFrame:
    """``part, place, line``: sorted by part and place the lines are one JSON object {"concepts": [...], "edges": [...]}.

    Concepts have id, name, category, description and mention_count, edges the names of their ends, type and
    weight. The text is never put together in one row; elements after the first begin with a comma.
    """
    chosen, keep = _exported(concepts, category), {"ignoreNullFields": "false"}
    names = broadcast_if_small(chosen.select("id", "name"), MOST_CONCEPTS)
    kept = export_edges(edges, concepts, category, min_weight)
    ends = kept.join(names.select(F.col("id").alias("src_id"), F.col("name").alias("src")), "src_id").join(names.select(F.col("id").alias("dst_id"), F.col("name").alias("dst")), "dst_id")
    nodes = _lines(chosen, 1, _place("id"), F.to_json(F.struct("id", "name", "category", "description", "mention_count"), keep))
    links = _lines(ends, 3, _place("src_id", "dst_id", "relation"), F.to_json(F.struct("src", "dst", F.col("relation").alias("type"), "weight"), keep))

    def with_commas(rows: DataFrame) -> DataFrame:
        first = rows.agg(F.min("place").alias("first"))  # one row
        return rows.crossJoin(F.broadcast(first)).select("part", "place", F.concat(F.when(F.col("place") == F.col("first"), "").otherwise(","), F.col("line")).alias("line"))

    fixed = concepts.sparkSession.createDataFrame([(0, "", '{"concepts": ['), (2, "", '], "edges": ['), (4, "", "]}")], "part int, place string, line string")
    return fixed.unionByName(with_commas(nodes)).unionByName(with_commas(links))


# ----------------------------------------------------------------------------- extraction results
def extract_json(responses: DataFrame, text: str = "response") -> DataFrame:
    """``responses`` with concepts and relations read from a model's answer.

    The object lies in a fenced block or from the first '{' to the last '}'. Concepts without a name and
    relations without source, target and type are dropped; what cannot be read gives empty lists.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(t.rlike(r"(?s)```(?:json)?\s*(.*?)```"), fenced).otherwise(t)
    read = responses.withColumn("_j", F.from_json(F.regexp_extract(body, r"(?s)(\{.*\})", 1), schema.EXTRACTION))
    def said(c: Column) -> Column:
        return c.isNotNull() & (tx.trimmed(c) != "")

    concepts = F.filter("_j.concepts", lambda c: said(c["name"]))
    relations = F.filter("_j.relations", lambda r: said(r["src"]) & said(r["dst"]) & said(r["type"]))
    empty = {name: F.from_json(F.lit("[]"), kind) for name, kind in (("concepts", schema.CONCEPT_LIST), ("relations", schema.RELATION_LIST))}
    return read.withColumns({"concepts": F.coalesce(concepts, empty["concepts"]), "relations": F.coalesce(relations, empty["relations"])}).drop("_j")


def read_items(items: DataFrame, json: str = "item") -> DataFrame:
    """Extraction items from JSON text; items without doc_id or chunk_index are dropped."""
    return items.select(F.from_json(json, schema.ITEMS).alias("i")).select("i.*").filter("doc_id is not null and doc_id <> '' and chunk_index is not null")


def item_mentions(items: DataFrame) -> DataFrame:
    """``doc_id, chunk_index, section_path, category, name, slug, aliases, description, position`` of each named concept."""
    rows = items.select("doc_id", "chunk_index", F.coalesce("section_path", F.lit("")).alias("section_path"), "category", F.posexplode("concepts").alias("position", "c"))
    named = rows.select("doc_id", "chunk_index", "section_path", "category", "position", tx.trimmed("c.name").alias("name"), "c.aliases", tx.trimmed(F.coalesce("c.description", F.lit(""))).alias("description"))
    return named.filter("name <> ''").withColumn("slug", tx.slug("name"))


def item_relations(items: DataFrame) -> DataFrame:
    """``doc_id, chunk_index, src_slug, dst_slug, relation``; relations of items without concepts are dropped."""
    rows = items.filter(F.size("concepts") > 0).select("doc_id", "chunk_index", F.explode("relations").alias("r"))
    def said(c: str) -> Column:
        return F.col(c).isNotNull() & (tx.trimmed(F.col(c)) != "")

    full = rows.filter(said("r.src") & said("r.dst") & said("r.type"))
    return full.select("doc_id", "chunk_index", tx.slug("r.src").alias("src_slug"), tx.slug("r.dst").alias("dst_slug"), F.col("r.type").alias("relation"))


def store_items(items: DataFrame, concepts: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(mentions, edge occurrences)`` of items whose concepts are resolved by slug, then alias.

    Mentions have concept_id, doc_id, chunk_index, section_path; occurrences src_id, dst_id, relation, loops left out.
    """
    named = item_mentions(items)
    relations = item_relations(items)
    slugs = named.select("slug").unionByName(relations.select(F.col("src_slug").alias("slug"))).unionByName(relations.select(F.col("dst_slug").alias("slug"))).distinct()
    by_slug = concepts.groupBy("slug").agg(F.min("id").alias("s"))
    by_alias = aliases.groupBy(F.col("alias_slug").alias("slug")).agg(F.min("concept_id").alias("a"))
    known = slugs.join(by_slug, "slug", "left").join(by_alias, "slug", "left").select("slug", F.coalesce("s", "a").alias("id")).filter("id is not null")
    known = broadcast_if_small(known, MOST_CONCEPTS)
    mentions = named.join(known, "slug").select(F.col("id").alias("concept_id"), "doc_id", "chunk_index", "section_path")
    ends = relations.join(known.select(F.col("slug").alias("src_slug"), F.col("id").alias("src_id")), "src_slug").join(known.select(F.col("slug").alias("dst_slug"), F.col("id").alias("dst_id")), "dst_slug")
    return distinct_mentions(mentions), ends.filter("src_id <> dst_id").select("src_id", "dst_id", "relation")


# ----------------------------------------------------------------------------- entity resolution
def _hashed_pairs(vectors: DataFrame, threshold: float, dim: int, recall: float = 0.995) -> DataFrame:
    """``a, b``: links that join the slugs connected by pairs with at least this cosine, found by signs of random projections.

    Buckets of about 32 vectors; as many tables as give a pair at the threshold this chance of being found
    (pairs above it are found more surely). Of equal vectors only the first slug is looked at, linked with the
    others; of each group of a bucket only the links to its first member are told, so many similar vectors
    give as many links and not their square.
    """
    named = vectors.withColumn("look", F.md5(F.array_join(F.col("embedding").cast("array<string>"), ",")))
    firsts = cut_lineage(named.groupBy("look").agg(F.min("slug").alias("slug"), F.min_by("embedding", "slug").alias("embedding")))
    copies = named.join(firsts.select("look", F.col("slug").alias("first")), "look").filter("slug <> first").select(F.least("first", "slug").alias("a"), F.greatest("first", "slug").alias("b"))
    vectors = firsts.select("slug", "embedding")
    n = vectors.count()
    bits = max(4, min(40, math.ceil(math.log2(max(2, n) / 32))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    tables = math.ceil(math.log(1 - recall) / math.log(1 - meet))
    planes = np.random.default_rng(11).standard_normal((dim, tables * bits)).astype(np.float32)
    shared = vectors.sparkSession.sparkContext.broadcast(planes)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["embedding"].to_numpy()).astype(np.float32)
            code = ((x @ shared.value) > 0).reshape(len(x), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
            for t in range(tables):
                yield pd.DataFrame({"bucket": code[:, t] * tables + t, "slug": batch["slug"], "embedding": batch["embedding"]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pd.concat(held)
        for _, own in rows.groupby("bucket", sort=False):
            if len(own) < 2:
                continue
            x = np.stack(own["embedding"].to_numpy()).astype(np.float64)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            names = own["slug"].to_numpy()
            near = np.zeros(len(x), bool)
            for a in range(0, len(x), 1024):
                near[a : a + 1024] = (x[a : a + 1024] @ x.T >= threshold - 1e-9).sum(1) > 1
            rest = np.flatnonzero(near)
            while len(rest):  # one connected group after the other
                start, todo, rest = rest[0], [rest[0]], rest[1:]
                while todo and len(rest):
                    hit = x[rest] @ x[todo.pop()] >= threshold - 1e-9
                    found, rest = rest[hit], rest[~hit]
                    todo += found.tolist()
                    if len(found):
                        yield pd.DataFrame({"a": np.minimum(names[start], names[found]), "b": np.maximum(names[start], names[found])})

    placed = vectors.mapInPandas(place, "bucket bigint, slug string, embedding array<float>")
    return placed.repartition(spread(n * tables, 50_000, 4), "bucket").mapInPandas(compare, "a string, b string").unionByName(copies).distinct()


def resolve_in_order(slugs: pd.DataFrame, aliases: pd.DataFrame, threshold: float = SAME_CONCEPT) -> pd.DataFrame:
    """The rule itself, one occurrence after the other: by slug, by alias, by the most similar concept, else a new concept.

    ``slugs`` has slug, at and embedding (or None), one row per slug with its first place; ``aliases`` has
    alias_slug, slug and at. A name found by similarity becomes an alias of what it was found as.
    """
    events = [(r.at, 0, r.slug, r.embedding) for r in slugs.itertuples()] + [(r.at, 1, r.slug, r.alias_slug) for r in aliases.itertuples()]
    concept: dict[str, str] = {}  # slug -> concept it resolved to
    known: dict[str, str] = {}  # alias slug -> first concept that has it
    names: list[str] = []
    vectors: list[np.ndarray] = []
    out = []
    for _, kind, slug, value in sorted(events, key=lambda e: (e[0], e[1], e[2], str(e[3]) if e[1] else "")):
        if kind:
            known.setdefault(value, concept[slug])
            continue
        how = "new"
        if slug in known:
            concept[slug], how = known[slug], "alias"
        elif value is not None and vectors:
            v = np.asarray(value, np.float64)
            length = np.sqrt(v @ v)
            near = np.array(vectors) @ (v / length) if length > 0 else np.zeros(len(vectors))
            best = int(near.argmax())
            if near[best] >= threshold:
                concept[slug], how = names[best], "similar"
                known.setdefault(slug, names[best])
        if how == "new":
            concept[slug] = slug
            if value is not None:
                v = np.asarray(value, np.float64)
                length = np.sqrt(v @ v)
                if length > 0:
                    names.append(slug), vectors.append(v / length)
        out.append((slug, concept[slug], how))
    return pd.DataFrame(out, columns=["slug", "concept_slug", "how"])


def resolve_concepts(occurrences: DataFrame, threshold: float = SAME_CONCEPT, dim: int = 64) -> DataFrame:
    """``slug, concept_slug, how`` (new, alias or similar) for each slug of the occurrences.

    ``occurrences`` has at (a total order, as string or number), name, aliases array<string> and embedding; existing
    concepts come first as the earliest ones. Only the first occurrence of a slug and the first declaration
    of an alias can matter, so these are what is kept, whatever the number of occurrences. Slugs that share an
    alias or are similar form components; the sequential rule runs inside each component. That is what one run
    over everything gives, but for similar pairs that the random projections miss (one in 200 at the
    threshold, fewer above). Blank names vanish.
    """
    rows = occurrences.select("at", tx.slug("name").alias("slug"), "aliases", "embedding").filter("slug <> ''")
    vector = F.when(usable("embedding", dim), F.col("embedding"))
    first = cut_lineage(rows.groupBy("slug").agg(F.min("at").alias("at"), F.min_by(vector, "at").alias("embedding")))
    declared = rows.select("slug", "at", F.explode("aliases").alias("alias")).select(tx.slug("alias").alias("alias_slug"), "slug", "at").filter("alias_slug <> ''")
    declared = cut_lineage(declared.groupBy("alias_slug", "slug").agg(F.min("at").alias("at")))
    similar = _hashed_pairs(first.filter("embedding is not null").select("slug", "embedding"), threshold, dim)
    links = similar.unionByName(declared.select(F.col("slug").alias("a"), F.col("alias_slug").alias("b")))
    roots = connected(links)
    slugs = first.join(roots.withColumnRenamed("id", "slug"), "slug", "left")
    alone = slugs.filter("root is null").select("slug", F.col("slug").alias("concept_slug"), F.lit("new").alias("how"))
    named = declared.join(roots.withColumnRenamed("id", "slug"), "slug")

    def fold(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        return resolve_in_order(own, others, threshold)

    # Both sides stem from the roots: fresh column names keep them apart.
    left, right = slugs.filter("root is not null").toDF(*slugs.columns), named.toDF(*named.columns)
    grouped = left.groupBy("root").cogroup(right.groupBy("root"))
    return alone.unionByName(grouped.applyInPandas(fold, "slug string, concept_slug string, how string"))


def cosine_of_edges(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """``src_id, dst_id, relation, cosine`` of the two ends; 0 where one has no usable vector of the same length."""
    vectors = concepts.select("id", "embedding")
    rows = edges.select("src_id", "dst_id", "relation").join(vectors.select(F.col("id").alias("src_id"), F.col("embedding").alias("a")), "src_id").join(vectors.select(F.col("id").alias("dst_id"), F.col("embedding").alias("b")), "dst_id")
    return rows.select("src_id", "dst_id", "relation", F.round(cosine("a", "b"), DIGITS).alias("cosine"))

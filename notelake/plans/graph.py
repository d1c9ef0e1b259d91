"""Queries over the concept graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


from notelake.operators import graph as gr
from notelake.plans.registry import CUR, query, sql_slug
from notelake.plans.search import _QUERY_VECTORS, _usable, golden_vectors
from notelake.plans.storage import chunks
from notelake.runtime import table


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return tuple(table(spark, sf_dir, n) for n in ("concepts", "concept_aliases", "concept_edges", "concept_mentions"))


@query(f"SELECT id, {sql_slug('name')} AS slug FROM concepts")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notelake.functions.text import slug

    return table(spark, sf_dir, "concepts").select("id", slug("name").alias("slug"))


@query("""SELECT src_id, dst_id, relation, round(CASE WHEN len(a.embedding) = len(b.embedding) AND len(a.embedding) > 0
AND list_aggregate(list_transform(a.embedding, lambda x: x::DOUBLE * x), 'sum') > 0 AND list_aggregate(list_transform(b.embedding, lambda x: x::DOUBLE * x), 'sum') > 0
THEN list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ELSE 0 END, 6) AS cosine
FROM concept_edges e JOIN concepts a ON a.id = e.src_id JOIN concepts b ON b.id = e.dst_id""")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts, _, edges, _ = _tables(spark, sf_dir)
    return gr.cosine_of_edges(edges, concepts)


@query(f"""WITH u AS (SELECT id, embedding::DOUBLE[] AS v FROM concepts WHERE {_usable('embedding')})
SELECT a.id AS concept_id, b.id AS other_id, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM u a, u b
WHERE a.id % 50 = 0 AND a.id <> b.id AND round(list_cosine_similarity(a.v, b.v), 6) >= 0.88""")
def concept_similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = table(spark, sf_dir, "concepts")
    return gr.similar_concepts(concepts, concepts.filter("id % 50 = 0"))


def chained_mentions(mentions: DataFrame) -> DataFrame:
    """Occurrences of 'related_to' between each mention of a chunk and the next one by concept id."""
    following = F.lead("concept_id").over(Window.partitionBy("doc_id", "chunk_index").orderBy("concept_id"))
    rows = gr.distinct_mentions(mentions).withColumn("next", following).filter("next is not null")
    return rows.select(F.col("concept_id").alias("src_id"), F.col("next").alias("dst_id"), F.lit("related_to").alias("relation"))


_CHAIN = """m AS (SELECT DISTINCT concept_id, doc_id, chunk_index FROM concept_mentions),
ch AS (SELECT concept_id AS src_id, lead(concept_id) OVER (PARTITION BY doc_id, chunk_index ORDER BY concept_id) AS dst_id FROM m)"""


@query(f"""WITH {_CHAIN}, f AS (SELECT src_id, dst_id, 'related_to' AS relation, count(*) AS n FROM ch WHERE dst_id IS NOT NULL AND src_id <> dst_id GROUP BY ALL)
SELECT src_id, dst_id, relation, sum(weight) AS weight, CAST(sum(evidence_count) AS BIGINT) AS evidence_count
FROM (SELECT src_id, dst_id, relation, weight, evidence_count FROM concept_edges UNION ALL SELECT src_id, dst_id, relation, n::DOUBLE, n FROM f) GROUP BY ALL""")
def edge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, edges, mentions = _tables(spark, sf_dir)
    return gr.accumulate_edges(edges, chained_mentions(mentions))


@query("""SELECT id AS concept_id, coalesce(n, 0) AS mentions, mention_count AS stored FROM concepts
LEFT JOIN (SELECT concept_id, count(*) AS n FROM (SELECT DISTINCT concept_id, doc_id, chunk_index FROM concept_mentions) GROUP BY 1) ON concept_id = id""")
def concept_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts, _, _, mentions = _tables(spark, sf_dir)
    return gr.mention_counts(concepts, mentions)


@query("SELECT concept_id, doc_id, chunk_index, min(section_path) AS section_path FROM concept_mentions GROUP BY ALL")
def mentions_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.distinct_mentions(table(spark, sf_dir, "concept_mentions"))


@query(f"""WITH n AS (SELECT DISTINCT name, {sql_slug('name')} AS slug FROM (SELECT name FROM concepts UNION ALL SELECT alias FROM concept_aliases)),
s AS (SELECT slug, min(id) AS s FROM concepts GROUP BY 1), a AS (SELECT alias_slug AS slug, min(concept_id) AS a FROM concept_aliases GROUP BY 1)
SELECT name, slug, coalesce(s, a) AS concept_id, CASE WHEN s IS NOT NULL THEN 'slug' WHEN a IS NOT NULL THEN 'alias' END AS found_by
FROM n LEFT JOIN s USING (slug) LEFT JOIN a USING (slug)""")
def concept_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts, aliases, _, _ = _tables(spark, sf_dir)
    return gr.concept_lookup(concepts.select("name").unionByName(aliases.select(F.col("alias").alias("name"))), concepts, aliases)


def _edges_sql(near: str, far: str, direction: str, top: str = "", where: str = "true") -> str:
    return f"""SELECT concept_id, direction, relation, weight, other_id, other, rank FROM (SELECT {near} AS concept_id, '{direction}' AS direction, relation, weight, {far} AS other_id, name AS other,
CAST(row_number() OVER (PARTITION BY {near} ORDER BY weight DESC NULLS LAST, name, {far}, relation) AS INTEGER) AS rank
FROM concept_edges JOIN concepts ON id = {far} WHERE src_id IS NOT NULL AND dst_id IS NOT NULL AND {where}) {top}"""


@query(_edges_sql("src_id", "dst_id", "out"))
def edges_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts, _, edges, _ = _tables(spark, sf_dir)
    return gr.list_edges(edges, concepts, "out")


@query(_edges_sql("dst_id", "src_id", "in", where="relation = 'part_of'"))
def edges_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts, _, edges, _ = _tables(spark, sf_dir)
    return gr.list_edges(edges, concepts, "in", relation="part_of")


@query(_edges_sql("src_id", "dst_id", "out", "WHERE rank <= 5") + " UNION ALL " + _edges_sql("dst_id", "src_id", "in", "WHERE rank <= 5"))
def related_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts, _, edges, _ = _tables(spark, sf_dir)
    return gr.list_edges(edges, concepts, "both", top_k=5)


@query("""WITH o AS (SELECT *, coalesce(weight, -1) AS w FROM concept_edges WHERE src_id IS NOT NULL AND dst_id IN (SELECT id FROM concepts)),
f AS (SELECT * FROM o WHERE src_id % 50 = 0 AND src_id IN (SELECT id FROM concepts)),
b AS (SELECT src_id AS concept_id, dst_id AS via_id, w AS w1 FROM (SELECT *, row_number() OVER (PARTITION BY src_id, dst_id ORDER BY w DESC, relation) AS r FROM f) WHERE r = 1),
p AS (SELECT b.concept_id, o.dst_id AS other_id, b.via_id, o.relation, o.weight, w1, o.w AS w2 FROM b JOIN o ON o.src_id = b.via_id
  WHERE o.dst_id <> b.concept_id AND (b.concept_id, o.dst_id) NOT IN (SELECT (src_id, dst_id) FROM f))
SELECT src_id AS concept_id, 1 AS hop, dst_id AS other_id, NULL::BIGINT AS via_id, relation, weight FROM f
UNION ALL SELECT concept_id, 2, other_id, via_id, relation, weight FROM (SELECT *, row_number() OVER (PARTITION BY concept_id, other_id ORDER BY w1 DESC, w2 DESC, via_id, relation) AS r FROM p) WHERE r = 1""")
def two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts, _, edges, _ = _tables(spark, sf_dir)
    return gr.two_hop(edges, concepts, concepts.filter("id % 50 = 0"))


@query(f"""WITH {_QUERY_VECTORS}, near AS (SELECT query_id, id AS concept_id, round((1 + list_cosine_similarity(vector, embedding::DOUBLE[])) / 2, 6) AS score
  FROM (SELECT * FROM qv WHERE {_usable('vector')}) q, (SELECT * FROM concepts WHERE {_usable('embedding')}) c)
SELECT query_id, concept_id, round(2 * score - 1, 5) AS score, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, concept_id::VARCHAR) AS rank FROM near) WHERE rank <= 10""")
def search_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.search_concepts(table(spark, sf_dir, "concepts"), golden_vectors(spark, sf_dir))


@query("""SELECT name, rows FROM (SELECT 'concepts' AS name, count(*) AS rows FROM concepts UNION ALL SELECT 'aliases', count(*) FROM concept_aliases
UNION ALL SELECT 'edges', count(*) FROM concept_edges UNION ALL SELECT 'mentions', count(*) FROM concept_mentions
UNION ALL SELECT 'documents', count(DISTINCT doc_id) FROM chunks UNION ALL SELECT 'runs', 0)""")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts, aliases, edges, mentions = _tables(spark, sf_dir)
    from notelake import schema

    docs = table(spark, sf_dir, "chunks").select("doc_id").filter("doc_id is not null").distinct()
    return gr.graph_stats({"concepts": concepts, "aliases": aliases, "edges": edges, "mentions": mentions, "documents": docs, "runs": spark.createDataFrame([], schema.RUNS)})


_KEPT = "SELECT * FROM concept_edges WHERE weight >= 0.5 AND src_id IN (SELECT id FROM concepts WHERE category = 'study') AND dst_id IN (SELECT id FROM concepts WHERE category = 'study')"


@query(_KEPT)
def graph_export_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts, _, edges, _ = _tables(spark, sf_dir)
    return gr.export_edges(edges, concepts, "study", 0.5)


@query(f"""SELECT 0 AS part, '' AS place, 'graph LR' AS line
UNION ALL SELECT 1, printf('%020d', id), '  n' || id || '["' || translate(coalesce(name, ''), '"', '''') || '"]' FROM concepts WHERE category = 'study'
UNION ALL SELECT 2, printf('%020d|%020d|%s', src_id, dst_id, coalesce(relation, '')), '  n' || src_id || ' -- ' || coalesce(relation, '') || ' --> n' || dst_id FROM ({_KEPT})""")
def graph_export_mermaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts, _, edges, _ = _tables(spark, sf_dir)
    return gr.export_mermaid(edges, concepts, "study", 0.5)


@query("""WITH c AS (SELECT printf('%020d', id) AS place, to_json({'id': id, 'name': name, 'category': category, 'description': description, 'mention_count': mention_count})::VARCHAR AS line FROM concepts),
e AS (SELECT printf('%020d|%020d|%s', src_id, dst_id, coalesce(relation, '')) AS place, to_json({'src': a.name, 'dst': b.name, 'type': relation, 'weight': weight})::VARCHAR AS line
  FROM concept_edges JOIN concepts a ON a.id = src_id JOIN concepts b ON b.id = dst_id WHERE weight >= 1)
SELECT 0 AS part, '' AS place, '{"concepts": [' AS line UNION ALL SELECT 2, '', '], "edges": [' UNION ALL SELECT 4, '', ']}'
UNION ALL SELECT 1, place, CASE WHEN place = (SELECT min(place) FROM c) THEN '' ELSE ',' END || line FROM c
UNION ALL SELECT 3, place, CASE WHEN place = (SELECT min(place) FROM e) THEN '' ELSE ',' END || line FROM e""")
def graph_export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts, _, edges, _ = _tables(spark, sf_dir)
    return gr.export_json(edges, concepts)


@query(f"""WITH {CUR} SELECT category, count(*) AS chunks, count(*) * 1500 AS input_tokens, count(*) * 300 AS output_tokens,
round(count(*) * 1500 / 1e6 + count(*) * 300 / 1e6 * 5, 4) AS dollars FROM cur GROUP BY category""")
def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.cost_estimate(chunks(spark, sf_dir))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extraction item per chunk with mentions, as JSON: its concepts by id, a relation from each to the next."""
    concepts = table(spark, sf_dir, "concepts").select(F.col("id").alias("concept_id"), "name", "description")
    rows = gr.distinct_mentions(table(spark, sf_dir, "concept_mentions")).join(concepts, "concept_id")
    lists = rows.groupBy("doc_id", "chunk_index").agg(F.array_sort(F.collect_list(F.struct("concept_id", "name", "description", "section_path"))).alias("l"))
    named = F.transform("l", lambda c: F.struct(c["name"].alias("name"), F.array().cast("array<string>").alias("aliases"), c["description"].alias("description")))
    later = F.slice("l", 2, F.size("l"))
    linked = F.filter(F.zip_with("l", later, lambda a, b: F.struct(a["name"].alias("src"), b["name"].alias("dst"), F.lit("related_to").alias("type"))), lambda r: r["dst"].isNotNull())
    one = F.struct("doc_id", "chunk_index", F.element_at("l", 1)["section_path"].alias("section_path"), named.alias("concepts"), linked.alias("relations"))
    return lists.select(F.to_json(one).alias("item"))


@query(f"""WITH m AS (SELECT DISTINCT concept_id, doc_id, chunk_index FROM concept_mentions WHERE doc_id IS NOT NULL AND doc_id <> '' AND chunk_index IS NOT NULL),
s AS (SELECT slug, min(id) AS s FROM concepts GROUP BY 1), a AS (SELECT alias_slug AS slug, min(concept_id) AS a FROM concept_aliases GROUP BY 1),
n AS (SELECT c.id AS concept_id, c.name, coalesce(s.s, a.a) AS found FROM concepts c LEFT JOIN s ON s.slug = {sql_slug('c.name')} LEFT JOIN a ON a.slug = {sql_slug('c.name')}),
l AS (SELECT found AS src, lead(found) OVER w AS dst, lead(concept_id) OVER w AS more FROM m JOIN n USING (concept_id) WINDOW w AS (PARTITION BY doc_id, chunk_index ORDER BY concept_id))
SELECT src AS src_id, dst AS dst_id, 'related_to' AS relation, count(*) AS evidence FROM l WHERE more IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL AND src <> dst GROUP BY ALL""")
def store_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts, aliases, _, _ = _tables(spark, sf_dir)
    _, occurrences = gr.store_items(gr.read_items(items(spark, sf_dir)), concepts, aliases)
    return occurrences.groupBy("src_id", "dst_id", "relation").agg(F.count("*").alias("evidence"))


@query("""SELECT id, CASE WHEN id % 5 = 4 OR id % 7 = 3 THEN 0 ELSE 1 END AS concepts, CASE WHEN id % 5 = 4 OR id % 7 = 3 THEN NULL ELSE name END AS first,
CASE WHEN id % 5 = 4 OR id % 7 = 3 THEN 0 ELSE 1 END AS relations FROM concepts WHERE name IS NOT NULL AND trim(name) <> '' AND slug <> ''""")
def extract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in all shapes: fenced, bare between words, broken, or empty; each with a nameless concept to drop."""
    concepts = table(spark, sf_dir, "concepts").filter("name is not null and trim(name) <> '' and slug <> ''")
    one = F.struct(F.array(F.struct("name"), F.struct(F.lit(" ").alias("name"))).alias("concepts"),
                   F.array(F.struct(F.col("name").alias("src"), F.col("slug").alias("dst"), F.lit("part_of").alias("type")), F.struct(F.lit("").alias("src"), F.lit("x").alias("dst"), F.lit("y").alias("type"))).alias("relations"))
    body = F.to_json(one)
    answer = (
        F.when(F.col("id") % 7 == 3, "").when(F.col("id") % 5 == 4, F.concat(F.lit("```json\n"), F.substring(body, 1, 12), F.lit("\n```")))
        .when(F.col("id") % 2 == 0, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("Sure. "), body, F.lit(" Anything else?")))
    )
    read = gr.extract_json(concepts.select("id", answer.alias("response")))
    return read.select("id", F.size("concepts").alias("concepts"), F.get("concepts", F.lit(0))["name"].alias("first"), F.size("relations").alias("relations"))


@query(rf"""WITH {CUR}, w AS (SELECT doc_id, chunk_index, regexp_extract_all(substring(content, 1, 4000), '\b[A-Z][a-z]{{4,}}\b') AS ws FROM cur),
n AS (SELECT doc_id, chunk_index, list_filter(ws, lambda x, i: list_position(ws, x) = i) AS ns FROM w),
p AS (SELECT unnest([{{'a': ns[i], 'b': ns[i + 1]}} for i in range(1, len(ns))]) AS p FROM n)
SELECT {sql_slug('p.a')} AS src_slug, {sql_slug('p.b')} AS dst_slug, 'related_to' AS relation, count(*) AS evidence FROM p GROUP BY ALL""")
def extract_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offline extractor over all chunks, read back as items: how often each relation was seen."""
    from notelake.operators.providers import extract

    answers = chunks(spark, sf_dir).select("doc_id", "chunk_index", extract(F.substring("content", 1, 4000)).alias("response"))
    return gr.item_relations(gr.extract_json(answers)).groupBy("src_slug", "dst_slug", "relation").agg(F.count("*").alias("evidence"))


@query()
def resolve_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All concepts, with their aliases, resolved as if met in the order of their ids."""
    concepts, aliases, _, _ = _tables(spark, sf_dir)
    lists = aliases.groupBy("concept_id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    met = concepts.join(lists, concepts.id == lists.concept_id, "left").select(F.col("id").alias("at"), "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "embedding")
    return gr.resolve_concepts(met)


@query(f"""WITH {CUR} SELECT 1::BIGINT AS id, '2025-01-01 00:00:00' AS started, '2025-01-01 00:00:00' AS finished, 'study' AS scope_category, NULL::VARCHAR AS scope_doc_id,
(SELECT count(*) FROM cur) AS chunks_processed, (SELECT count(*) FROM concepts) AS concepts_added, (SELECT count(*) FROM concept_edges) AS edges_added, 'offline' AS model, 'done' AS status""")
def graph_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts, _, edges, _ = _tables(spark, sf_dir)
    run = gr.graph_run(1, chunks(spark, sf_dir), concepts, edges, "study", "2025-01-01 00:00:00")
    times = {name: F.date_format(f"{name}_at", "yyyy-MM-dd HH:mm:ss").alias(name) for name in ("started", "finished")}
    return run.select("id", *times.values(), "scope_category", "scope_doc_id", "chunks_processed", "concepts_added", "edges_added", "model", "status")


@query(f"WITH {CUR} SELECT concept_id, doc_id, chunk_index, section_path FROM concept_mentions WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM cur WHERE category = 'study' AND doc_id IS NOT NULL)")
def clear_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.clear_mentions(table(spark, sf_dir, "concept_mentions"), chunks(spark, sf_dir), category="study")

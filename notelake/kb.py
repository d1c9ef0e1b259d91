"""A knowledge base in a folder: the operators of this package behind one object.

Below ``root`` lie the notes (``data/``), the tables (``store/``) and the search log (``logs/``). Tables are
spread over buckets by their key; a change rewrites the buckets it touches. Queries return data frames.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelake import schema
from notelake.functions import text as tx
from notelake.functions.vectors import hashed_embedding
from notelake.operators import graph as gr
from notelake.operators import providers as pv
from notelake.operators import retrieval as rt
from notelake.operators import sections as sc
from notelake.operators import store as st
from notelake.runtime import cut_lineage, numbered
from notelake.sources import files as fs
from notelake.sources.snapshots import SnapshotTable
from notelake.streaming.watch import doc_id_of

TABLES = {"chunks": schema.CHUNKS, "concepts": schema.CONCEPTS, "aliases": schema.ALIASES, "edges": schema.EDGES, "mentions": schema.MENTIONS, "documents": schema.GRAPH_DOCUMENTS, "runs": schema.RUNS}


#: What rows of a table are spread by.
KEYS = {"chunks": "doc_id", "concepts": "id", "aliases": "concept_id", "edges": "src_id", "mentions": "concept_id", "documents": "doc_id", "runs": None}


class KnowledgeBase:
    """``embed`` turns a text column into a vector column of ``dim`` numbers; see operators.providers for other stages.

    With ``vocabulary``, the path of a byte-pair vocabulary, chunk sizes are counted in its tokens.
    """

    def __init__(self, spark: SparkSession, root: str, embed: Callable[[Column], Column] | None = None, dim: int = 64, max_tokens: int = 500, overlap_tokens: int = 100, buckets: int = 16,
                 vocabulary: str | None = None, classify: Callable[[Column], Column] = pv.classify):
        self.vocabulary, self.classify = vocabulary, classify
        self.spark, self.root, self.dim = spark, root.rstrip("/"), dim
        self.max_tokens, self.overlap_tokens = max_tokens, overlap_tokens
        self.embed = embed or (lambda c: hashed_embedding(c, dim).cast("array<float>"))
        self.tables = {name: SnapshotTable(spark, f"{self.root}/store/{name}", ddl, KEYS[name], buckets) for name, ddl in TABLES.items()}

    def table(self, name: str) -> DataFrame:
        return self.tables[name].read()

    def _change(self, name: str, touched: DataFrame | list[int], function: Callable[[DataFrame], DataFrame]) -> None:
        """Rewrites the buckets that ``touched`` names, or that its rows fall into."""
        table = self.tables[name]
        buckets = touched if isinstance(touched, list) else table.buckets_of(touched)
        columns = self.table(name).columns
        table.change(buckets, lambda old: function(old).select(*columns))
        table.drop_old()

    def _ids(self, *doc_ids: str) -> DataFrame:
        return self.spark.createDataFrame([(d,) for d in doc_ids], "doc_id string")

    # ------------------------------------------------------------------ documents
    def _read(self, path: str, prefix: str, base: str) -> tuple[DataFrame, DataFrame]:
        """``(chunks, unread)``: chunk records, without embeddings, of the files below ``path``, and the files that cannot be read.

        An emptied file keeps one row with null content; ``unread`` has doc_id and reason.
        """
        plain = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
        found = fs.convert(fs.scan_files(self.spark, path)).select(doc_id_of(plain, base, prefix).alias("path"), "text", "modified_at").filter("path <> ''")
        files = cut_lineage(found)
        unread = files.filter("text is null").select(F.col("path").alias("doc_id"), fs.unread_reason("path").alias("reason"))
        parsed = fs.with_frontmatter(files.filter("text is not null")).select(F.col("path").alias("doc_id"), F.col("body").alias("text"), "title", "tags", "expires_at", "modified_at")
        chunks = sc.process_files(parsed, self.max_tokens, self.overlap_tokens, self.vocabulary)
        empty = parsed.select("doc_id").join(chunks.select("doc_id").distinct(), "doc_id", "left_anti")
        rows = chunks.unionByName(empty.withColumn("chunk_index", F.lit(0)), allowMissingColumns=True)
        missing = {c: F.lit(None).cast(t) for c, t in (("embedding", "array<float>"), ("archived_at", "timestamp"), ("archive_reason", "string"))}
        return cut_lineage(rows.withColumns(missing)), unread

    def add(self, path: str, prefix: str = "", base: str | None = None, category: str | None = None, tags: list[str] | None = None, reset_lifecycle: bool = False) -> DataFrame:
        """Ingests a file or folder as a delta; returns its counters in one row. Only new or changed chunks are embedded.

        ``unread`` counts the files that could not be read; :meth:`unread` lists them.
        """
        new, unread = self._read(path, prefix, base or self.root)
        self.last_unread = cut_lineage(unread)
        if category:
            new = new.withColumn("category", F.lit(category))
        if tags:
            new = new.withColumn("tags", F.array(*map(F.lit, tags)))
        old = self.tables["chunks"].read(buckets=self.tables["chunks"].buckets_of(new))
        changes = cut_lineage(st.delta(old, new))
        self._change("chunks", new, lambda own: st.merge(own, changes, new, reset_lifecycle, self.embed))
        return st.delta_stats(changes).crossJoin(F.broadcast(self.last_unread.agg(F.count("*").alias("unread"))))  # one row each

    def unread(self) -> DataFrame:
        """``doc_id, reason`` of the files the last :meth:`add` could not read."""
        return self.last_unread

    def reindex(self, vaults: tuple[str, ...] = ()) -> list[DataFrame]:
        """Drops all chunks and ingests data/, and each vault, anew; counters per source. Lifecycle fields start afresh."""
        self.tables["chunks"].drop()
        return [self.add(f"{self.root}/data"), *map(self.sync_vault, vaults)]

    def reindex_document(self, doc_id: str, vault: str | None = None) -> DataFrame:
        """Reads the file of one document again; a vault's document is named with its prefix."""
        if vault and doc_id.startswith("obsidian/"):
            return self.add(f"{vault.rstrip('/')}/{doc_id.removeprefix('obsidian/')}", prefix="obsidian/", base=vault, category="obsidian")
        return self.add(f"{self.root}/{doc_id}")

    def sync_vault(self, path: str) -> DataFrame:
        """Ingests a vault beside the notes under its own prefix and category."""
        return self.add(path, prefix="obsidian/", base=path, category="obsidian")

    def write_file(self, path: str, content: str, ingest: bool = True) -> str:
        """Writes a note below data/ (see sources.files.guarded_write) and ingests it."""
        target = fs.guarded_write(self.root, path, content)
        if ingest:
            self.add(target)
        return target

    def convert(self, source: str, content: bytes, category: str = tx.DEFAULT_CATEGORY, name: str | None = None, ingest: bool = True) -> str:
        """Converts a document to a note and ingests it; with category 'auto' the classifier reads the text and names one."""
        if category == "auto":
            text = fs.text_of_file(source, content)
            category = self.spark.createDataFrame([(text or "",)], "text string").select(self.classify(F.col("text"))).first()[0]
        target = fs.converted_file(self.root, source, content, category, name)
        if ingest:
            self.add(target)
        return target

    def list_documents(self, category: str | None = None, include_archived: bool = False) -> DataFrame:
        return st.list_documents(self.table("chunks"), category, include_archived)

    def get_document(self, doc_id: str, include_content: bool = True) -> DataFrame:
        return st.get_document(self.table("chunks"), doc_id, include_content)

    def archive(self, doc_id: str, reason: str | None = None, now: str | None = None) -> None:
        self._change("chunks", self._ids(doc_id), lambda own: st.archive_document(own, [doc_id], now, reason))

    def restore(self, doc_id: str) -> None:
        self._change("chunks", self._ids(doc_id), lambda own: st.restore_document(own, [doc_id]))

    def delete(self, doc_id: str) -> None:
        self._change("chunks", self._ids(doc_id), lambda own: st.delete_document(own, doc_id))

    def purge(self, before: str | None = None) -> None:
        self._change("chunks", self.table("chunks").filter("archived_at is not null"), lambda own: st.purge_archived(own, before))

    def doctor(self, now: str | None = None) -> tuple[DataFrame, DataFrame]:
        """``(categories, lifecycle)`` counts."""
        chunks = self.table("chunks")
        return st.doctor_categories(chunks), st.doctor_lifecycle(chunks, now)

    # ------------------------------------------------------------------ search
    def search(self, queries: DataFrame, category: str | None = None, include_archived: bool = False, now: str | None = None, expand: int = 0, log: bool = False, **options) -> DataFrame:
        """Hybrid search for ``queries`` (id, query); options as in operators.retrieval.hybrid_search. ``expand`` adds neighbours."""
        corpus = self.table("chunks")
        shown = F.lit(True) if include_archived else st.is_visible(now)
        if category:
            shown = shown & (F.col("category") == category)
        visible = None if include_archived and not category else shown
        vectors = queries.select(F.col("id").alias("query_id"), self.embed(F.col("query")).alias("vector"))
        hits = rt.hybrid_search(corpus, queries, vectors, visible, dim=self.dim, **options)
        if log:
            hits = cut_lineage(hits)
            self.log_search(queries, hits, category, options)
        return rt.neighbours(hits, corpus, expand) if expand else hits

    def log_search(self, queries: DataFrame, hits: DataFrame, category: str | None, options: dict) -> None:
        """Appends one JSON line per query to the search log."""
        reranked = F.col("rerank_score") if "rerank_score" in hits.columns else F.lit(None).cast("double")
        result = F.struct("rank", "doc_id", "chunk_index", "score", reranked.alias("rerank_score"))
        lists = hits.groupBy(F.col("query_id").alias("id")).agg(F.array_sort(F.collect_list(result)).alias("r"))
        bare = F.transform(F.coalesce("r", F.array()), lambda x: F.struct(x["doc_id"].alias("doc_id"), x["chunk_index"].alias("chunk_index"), x["score"].alias("score"), x["rerank_score"].alias("rerank_score")))
        lines = queries.select("id", "query").join(lists, "id", "left").select(
            F.current_timestamp().alias("ts"), "query", F.lit(category).cast("string").alias("category"), F.lit(options.get("top_k", rt.TOP_K)).alias("top_k"),
            F.lit(options.get("fusion", "rrf")).alias("fusion"), F.lit(options.get("reranked", True)).alias("reranked"), bare.alias("results"),
        )
        lines.write.mode("append").json(f"{self.root}/logs/search")

    def search_log(self) -> DataFrame:
        return self.spark.read.schema(schema.SEARCH_LOG).json(f"{self.root}/logs/search")

    # ------------------------------------------------------------------ graph
    def graph_chunks(self, category: str | None = None, doc_id: str | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
        return st.page_chunks(self.table("chunks"), category, doc_id, offset, limit)

    def store_concepts(self, items: DataFrame, now: str | None = None) -> DataFrame:
        """Takes extraction items as JSON (column item) into the graph; returns ``concepts, mentions, edges`` counted by calls.

        Existing concepts are the earliest occurrences; new ones get ids in the order they are met.
        """
        read = cut_lineage(gr.read_items(items))
        old, aliases = self.table("concepts"), self.table("aliases")
        named = cut_lineage(gr.item_mentions(read).withColumn("vector", self.embed(tx.embedding_text("name", "description"))))
        place = F.format_string("1|%s|%012d|%06d", "doc_id", "chunk_index", "position")
        none = F.array().cast("array<string>")
        known = old.join(aliases.groupBy("concept_id").agg(F.collect_list("alias").alias("a")), old.id == F.col("concept_id"), "left")
        met = named.select(place.alias("at"), "name", F.coalesce("aliases", none).alias("aliases"), F.col("vector").alias("embedding")).unionByName(
            known.select(F.format_string("0|%020d", "id").alias("at"), "name", F.coalesce("a", none).alias("aliases"), "embedding"))
        resolved = cut_lineage(gr.resolve_concepts(met, dim=self.dim))
        time = F.to_timestamp(F.lit(now)) if now else F.current_timestamp()
        first = named.withColumn("at", place).groupBy("slug").agg(F.min_by(F.struct("name", "category", "description", F.col("vector").alias("embedding"), "at"), "at").alias("f"))
        fresh = resolved.filter("slug = concept_slug").join(old.select("slug"), "slug", "left_anti").join(first, "slug")
        last = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
        counted = numbered(fresh.withColumn("at", F.col("f.at")), ["at"], "place").crossJoin(F.broadcast(last)).withColumn("id", F.col("last") + F.col("place"))  # last is one row
        added = counted.select("id", "f.name", "slug", "f.category", "f.description", "f.embedding", F.lit(0).cast("bigint").alias("mention_count"), time.alias("created_at"), time.alias("updated_at"))
        ids = cut_lineage(old.select("id", "slug").unionByName(added.select("id", "slug")))
        of = cut_lineage(resolved.join(ids.withColumnRenamed("slug", "concept_slug"), "concept_slug").select("slug", "id"))
        calls = named.join(of, "slug")
        counts = cut_lineage(calls.groupBy("id").agg(F.count("*").alias("calls")))
        said = calls.select(F.col("id").alias("concept_id"), F.explode("aliases").alias("alias")).filter("trim(alias) <> ''")
        found = resolved.filter("how = 'similar'").join(of, "slug").join(named.select("slug", "name"), "slug").select(F.col("id").alias("concept_id"), F.col("name").alias("alias"))
        more = cut_lineage(said.unionByName(found).withColumn("alias_slug", tx.slug("alias")))
        places = cut_lineage(calls.select(F.col("id").alias("concept_id"), "doc_id", "chunk_index", "section_path"))
        # An end of a relation is a concept named here, else one with this slug, else the first with this alias.
        ends = of.select("slug", "id", F.lit(0).alias("by")).unionByName(ids.select("slug", "id", F.lit(1).alias("by")))
        told = aliases.select("concept_id", "alias_slug").unionByName(more.select("concept_id", "alias_slug"))
        ends = ends.unionByName(told.select(F.col("alias_slug").alias("slug"), F.col("concept_id").alias("id"), F.lit(2).alias("by")))
        ends = ends.groupBy("slug").agg(F.min(F.struct("by", "id"))["id"].alias("id"))
        relations = gr.item_relations(read)
        joined = relations.join(ends.select(F.col("slug").alias("src_slug"), F.col("id").alias("src_id")), "src_slug").join(ends.select(F.col("slug").alias("dst_slug"), F.col("id").alias("dst_id")), "dst_slug")
        occurrences = cut_lineage(joined.filter("src_id <> dst_id").select("src_id", "dst_id", "relation"))
        added = cut_lineage(added.select(*old.columns))
        documents = self.table("documents")
        seen = read.groupBy("doc_id").agg(F.min_by(F.struct("title", "category"), "chunk_index").alias("d")).join(documents.select("doc_id"), "doc_id", "left_anti")
        document_ids = cut_lineage(seen.select(F.xxhash64("doc_id").alias("id"), "doc_id", "d.title", "d.category"))

        def counted_in(own: DataFrame) -> DataFrame:
            rows = own.unionByName(added).join(counts, "id", "left")  # new concepts are called, so their buckets are among those touched
            touched = F.col("calls").isNotNull()
            return rows.withColumn("mention_count", F.coalesce("mention_count", F.lit(0)) + F.coalesce("calls", F.lit(0))).withColumn("updated_at", F.when(touched, time).otherwise(F.col("updated_at")))

        self._change("concepts", counts, counted_in)
        self._change("aliases", more, lambda own: own.unionByName(more).dropDuplicates(["concept_id", "alias_slug"]))
        self._change("mentions", places, lambda own: gr.distinct_mentions(own.unionByName(places)))
        self._change("edges", occurrences, lambda own: gr.accumulate_edges(own, occurrences))
        self._change("documents", document_ids, lambda own: own.unionByName(document_ids))
        sums = [df.agg(F.count("*").alias(n)) for df, n in ((calls, "concepts"), (calls, "mentions"), (occurrences, "edges"))]
        return sums[0].crossJoin(sums[1]).crossJoin(sums[2])

    def search_concepts(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        vectors = queries.select(F.col("id").alias("query_id"), self.embed(F.col("query")).alias("vector"))
        return gr.search_concepts(self.table("concepts"), vectors, top_k, self.dim)

    def explain_concept(self, names: DataFrame, mentions: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
        """``(edges, hops, mentions)`` of the concepts that ``names`` (name) mean."""
        found = cut_lineage(gr.concept_lookup(names, self.table("concepts"), self.table("aliases")).filter("concept_id is not null").select(F.col("concept_id").alias("id")).distinct())
        edges, concepts = self.table("edges"), self.table("concepts")
        own = gr.list_edges(edges, concepts, "both").join(found.select(F.col("id").alias("concept_id")), "concept_id", "left_semi")
        places = self.table("mentions").join(found.select(F.col("id").alias("concept_id")), "concept_id", "left_semi")
        order = Window.partitionBy("concept_id").orderBy("doc_id", "chunk_index")
        return own, gr.two_hop(edges, concepts, found), places.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= mentions).drop("_r")

    def related_concepts(self, names: DataFrame, direction: str = "both", relation: str | None = None, top_k: int = 10) -> DataFrame:
        found = gr.concept_lookup(names, self.table("concepts"), self.table("aliases")).filter("concept_id is not null").select("concept_id").distinct()
        return gr.list_edges(self.table("edges"), self.table("concepts"), direction, relation, top_k).join(found, "concept_id", "left_semi")

    def graph_stats(self) -> DataFrame:
        return gr.graph_stats({n: self.table(n) for n in ("concepts", "aliases", "documents", "edges", "mentions", "runs")})

    def build_graph(self, extract: Callable[[Column], Column], category: str | None = None, doc_id: str | None = None, rebuild: bool = False, now: str | None = None, model: str = "offline", read_chars: int = 4000) -> DataFrame:
        """Extracts concepts from the chunks of a scope (``extract`` gives JSON) and stores them; a run is recorded.

        The extractor reads the first ``read_chars`` characters of a chunk. With ``rebuild`` the scope's mentions are dropped first.
        """
        chunks = st.scoped(self.table("chunks"), category, doc_id).filter("trim(content) <> ''")
        if rebuild:
            self._change("mentions", list(range(self.tables["mentions"].buckets)), lambda own: gr.clear_mentions(own, self.table("chunks"), category, doc_id))
        read = gr.extract_json(chunks.select("doc_id", "chunk_index", "section_path", "category", "title", extract(F.substring("content", 1, read_chars)).alias("response")))
        item = F.to_json(F.struct("doc_id", "chunk_index", "section_path", "category", "title", "concepts", "relations"))
        told = cut_lineage(self.store_concepts(read.filter(F.size("concepts") > 0).select(item.alias("item")), now))
        run = gr.graph_run(self.table("runs").count() + 1, chunks, told.select(F.explode(F.sequence(F.lit(1), "concepts"))).filter("true"), told.filter("edges > 0").select(F.explode(F.sequence(F.lit(1), F.col("edges").cast("int")))), category, now or "1970-01-01", model)
        one = run.withColumn("scope_doc_id", F.lit(doc_id).cast("string"))
        self._change("runs", [0], lambda own: own.unionByName(one.select(*own.columns)))
        return told

    def export_graph(self, path: str, category: str | None = None, min_weight: float = 1.0) -> str:
        """Writes the graph to one file, JSON or a diagram by its suffix, line by line; returns the path."""
        suffix = path.rsplit(".", 1)[-1].lower()
        if suffix not in ("json", "mmd", "md"):
            raise ValueError(f"{path}: a graph is exported as .json, .mmd or .md")
        form = gr.export_json if suffix == "json" else gr.export_mermaid
        with open(path, "w", encoding="utf-8") as file:
            for i, row in enumerate(form(self.table("edges"), self.table("concepts"), category, min_weight).orderBy("part", "place").select("line").toLocalIterator()):
                file.write("\n" * (i > 0) + row.line)
        return path

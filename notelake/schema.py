"""Schemas of the records the engine keeps, as Spark DDL."""

CHUNKS = """doc_id string, chunk_index int, content string, content_hash string, source_path string, category string,
section_path string, title string, tags array<string>, date_modified date, language string, embedding array<float>,
expires_at timestamp, archived_at timestamp, archive_reason string"""

CONCEPTS = """id bigint, name string, slug string, category string, description string, embedding array<float>,
mention_count bigint, created_at timestamp, updated_at timestamp"""
ALIASES = "concept_id bigint, alias string, alias_slug string"
EDGES = "src_id bigint, dst_id bigint, relation string, weight double, evidence_count bigint"
MENTIONS = "concept_id bigint, doc_id string, chunk_index int, section_path string"
GRAPH_DOCUMENTS = "id bigint, doc_id string, title string, category string"
RUNS = """id bigint, started_at timestamp, finished_at timestamp, scope_category string, scope_doc_id string,
chunks_processed bigint, concepts_added bigint, edges_added bigint, model string, status string"""

SEARCH_LOG = """ts timestamp, query string, category string, top_k int, fusion string, reranked boolean,
latency_ms map<string,double>, results array<struct<doc_id:string,chunk_index:int,score:double,rerank_score:double>>"""
GOLDEN = """id string, query string, category string, bucket string, type string,
relevant array<struct<doc_id:string,grade:int,reason:string>>"""
FILE_EVENTS = "event_id bigint, ts timestamp, event string, path string, dest_path string"
CONCEPT_LIST = "array<struct<name:string,aliases:array<string>,description:string>>"
RELATION_LIST = "array<struct<src:string,dst:string,type:string>>"
ITEMS = f"""doc_id string, chunk_index int, section_path string, category string, title string,
concepts {CONCEPT_LIST}, relations {RELATION_LIST}"""
EXTRACTION = f"concepts {CONCEPT_LIST}, relations {RELATION_LIST}"

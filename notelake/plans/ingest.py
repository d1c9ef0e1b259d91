"""Queries over the ingestion operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions import text as tx
from notelake.operators import sections as sc
from notelake.operators.providers import CATEGORY_WORDS, classified
from notelake.operators.store import current
from notelake.plans.registry import BLANK, CUR, query, sql_clean, sql_count_tokens, sql_stem, sql_tokens, sql_trim
from notelake.runtime import table
from notelake.sources import files as fs


@query(f"""WITH {CUR}, t AS (SELECT doc_id, chunk_index, {sql_tokens('content')} AS x FROM cur)
SELECT doc_id, chunk_index, len(x) AS tokens, md5(array_to_string(x, ' ')) AS digest FROM t""")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = current(table(spark, sf_dir, "chunks")).select("doc_id", "chunk_index", tx.tokens("content").alias("x"))
    return t.select("doc_id", "chunk_index", F.size("x").cast("bigint").alias("tokens"), F.md5(F.array_join("x", " ")).alias("digest"))


@query(f"SELECT doc_id, {sql_count_tokens('text')} AS tokens FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.token_count("text").cast("bigint").alias("tokens"))


@query("SELECT DISTINCT doc_id, chunk_index, sha256(content) AS hash FROM chunks")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select("doc_id", "chunk_index", tx.content_hash("content").alias("hash")).distinct()


@query("""SELECT DISTINCT doc_id, chunk_index,
CASE WHEN len(regexp_extract_all(substring(content, 1, 500), '[가-힣]')) > 10 THEN 'ko' ELSE 'en' END AS lang FROM chunks""")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select("doc_id", "chunk_index", tx.detect_language("content").alias("lang")).distinct()


@query(f"""WITH p AS (SELECT DISTINCT unnest(string_split(doc_id, '/')) AS part FROM chunks)
SELECT part, {sql_clean('part')} AS name FROM p""")
def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "chunks").select(F.explode(F.split("doc_id", "/")).alias("part")).distinct()
    return parts.select("part", tx.clean_name("part").alias("name"))


@query(f"""WITH d AS (SELECT DISTINCT doc_id FROM chunks),
p AS (SELECT doc_id, string_split(doc_id, '/') AS parts FROM d),
b AS (SELECT doc_id, CASE WHEN parts[1] = 'data' THEN parts[2:] ELSE parts END AS below FROM p),
n AS (SELECT doc_id, list_filter([{sql_clean('x')} for x in list_append(below[1:len(below) - 1], {sql_stem('doc_id')})], lambda y: y <> '') AS names FROM b)
SELECT doc_id, array_to_string(CASE WHEN len(names) > 2 THEN names[3:] ELSE names END, ' > ') AS section FROM n""")
def derive_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select("doc_id").distinct().select("doc_id", tx.derive_section("doc_id").alias("section"))


@query("""SELECT doc_id, CASE WHEN c IN ('about', 'career', 'study', 'writing') THEN c ELSE 'misc' END AS category
FROM (SELECT DISTINCT doc_id, regexp_extract(doc_id, '^data/([^/]+)', 1) AS c FROM chunks)""")
def derive_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select("doc_id").distinct().select("doc_id", tx.derive_category("doc_id").alias("category"))


@query(f"""WITH h AS (SELECT doc_id, path, list_filter([{sql_trim('x')} for x in string_split(text, chr(10))[1:10]], lambda y: starts_with(y, '# ')) AS heads FROM documents)
SELECT doc_id, coalesce({sql_trim('substring(heads[1], 3)')}, nullif({sql_clean(sql_stem('path'))}, ''), {sql_stem('path')}) AS title FROM h""")
def extract_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.extract_title("text", "path").alias("title"))


_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "yyyyMMdd", "yyyy-MM", "'on' dd.MM.yyyy", "yyyy-MM-dd HH:mm")


@query("""SELECT doc_id, CASE doc_id % 7
WHEN 0 THEN strftime(modified_at AT TIME ZONE 'UTC', '%Y-%m-%d 00:00:00') WHEN 1 THEN strftime(modified_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')
WHEN 3 THEN strftime(modified_at AT TIME ZONE 'UTC', '%Y-%m-%d 00:00:00') WHEN 6 THEN strftime(modified_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:00') END AS expires
FROM documents""")
def parse_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "modified_at")
    written = F.coalesce(*[F.when(F.col("doc_id") % 7 == i, F.date_format("modified_at", f)) for i, f in enumerate(_FORMATS)])
    return docs.select("doc_id", F.date_format(tx.parse_expiry(written), "yyyy-MM-dd HH:mm:ss").alias("expires"))


@query("SELECT DISTINCT doc_id, chunk_index, array_to_string(coalesce(tags, []), '|') AS tags FROM chunks")
def normalize_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = table(spark, sf_dir, "chunks").select("doc_id", "chunk_index", F.concat(F.array_join("tags", " ,  "), F.lit(" , ")).alias("typed"))
    return typed.select("doc_id", "chunk_index", F.array_join(tx.normalize_tags("typed"), "|").alias("tags")).distinct()


_DOCUMENTS = "d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)"

_SECTIONS = rf"""l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM d),
h AS (SELECT *, len(regexp_extract(line, '(?s)^(#{{1,3}}){BLANK}+(.+)$', 1)) AS lev, {sql_trim(f"regexp_extract(line, '(?s)^(#{{1,3}}){BLANK}+(.+)$', 2)")} AS name FROM l),
s AS (SELECT *, sum(CASE WHEN lev > 0 OR n = 1 THEN 1 ELSE 0 END) OVER w AS sec,
  max(CASE WHEN lev = 1 THEN n END) OVER w AS n1, max(CASE WHEN lev = 2 THEN n END) OVER w AS n2, max(CASE WHEN lev = 3 THEN n END) OVER w AS n3
  FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
p AS (SELECT s.*, CASE WHEN n1 IS NOT NULL THEN a.name END AS p1, CASE WHEN n2 > coalesce(n1, 0) THEN b.name END AS p2,
  CASE WHEN n3 > coalesce(n1, 0) AND n3 > coalesce(n2, 0) THEN c.name END AS p3
  FROM s LEFT JOIN (SELECT doc_id, n AS k, name FROM h) a ON a.doc_id = s.doc_id AND a.k = s.n1
  LEFT JOIN (SELECT doc_id, n AS k, name FROM h) b ON b.doc_id = s.doc_id AND b.k = s.n2
  LEFT JOIN (SELECT doc_id, n AS k, name FROM h) c ON c.doc_id = s.doc_id AND c.k = s.n3),
sections AS (SELECT doc_id, CAST(sec - 1 AS INTEGER) AS section, concat_ws(' > ', first(p1 ORDER BY n), first(p2 ORDER BY n), first(p3 ORDER BY n)) AS section_path,
  string_agg(line, chr(10) ORDER BY n) AS section_text FROM p GROUP BY doc_id, sec)"""


_LINES = f"{_DOCUMENTS},\n{_SECTIONS}"


@query(f"WITH {_LINES} SELECT doc_id, section, section_path, length(section_text) AS chars, md5(section_text) AS digest FROM sections")
def section_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = sc.sections(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return parts.select("doc_id", "section", "section_path", F.length("section_text").cast("bigint").alias("chars"), F.md5("section_text").alias("digest"))


MAX_TOKENS, OVERLAP_TOKENS = 120, 24


def _packed(documents: str, most: int, overlap: int) -> str:
    """CTEs from ``documents`` (a CTE d of doc_id and lines) to the chunks of each section (pieces)."""
    return f"""{documents},
{_SECTIONS},
q AS (SELECT doc_id, section, section_path, section_text, string_split(section_text, chr(10) || chr(10)) AS ps FROM sections),
t AS (SELECT *, [{sql_count_tokens('x')} for x in ps] AS ks, {sql_count_tokens('section_text')} AS total FROM q),
u AS (SELECT *, [coalesce(list_sum(ks[1:i]), 0)::BIGINT for i in range(0, len(ks) + 1)] AS sums FROM t),
r(doc_id, section, i, s, a, b) AS (
  SELECT doc_id, section, 0, 0, NULL::INTEGER, NULL::INTEGER FROM u WHERE total > {most}
  UNION ALL
  SELECT r.doc_id, r.section, r.i + 1,
    CASE WHEN f.cut THEN list_filter(range(r.s, r.i + 1), lambda j: u.sums[r.i + 1] - u.sums[j + 1] <= {overlap})[1]::INTEGER ELSE r.s END,
    CASE WHEN f.cut THEN r.s END, CASE WHEN f.cut THEN r.i END
  FROM r JOIN u ON u.doc_id = r.doc_id AND u.section = r.section,
  LATERAL (SELECT r.i < len(u.ps) AND u.sums[r.i + 2] - u.sums[r.s + 1] > {most} AND r.i > r.s AS cut) f
  WHERE r.i < len(u.ps)),
spans AS (SELECT doc_id, section, a, b FROM r WHERE a IS NOT NULL
  UNION ALL SELECT r.doc_id, r.section, r.s, r.i FROM r JOIN u ON u.doc_id = r.doc_id AND u.section = r.section WHERE r.i = len(u.ps)),
pieces AS (SELECT u.doc_id, u.section, u.section_path, spans.b AS o, {sql_trim("array_to_string(u.ps[spans.a + 1:spans.b], chr(10) || chr(10))")} AS content
  FROM spans JOIN u ON u.doc_id = spans.doc_id AND u.section = spans.section
  UNION ALL SELECT doc_id, section, section_path, 0, {sql_trim('section_text')} FROM u WHERE total <= {most})"""


_CHUNKS = _packed(_DOCUMENTS, MAX_TOKENS, OVERLAP_TOKENS)


@query(f"""WITH RECURSIVE {_CHUNKS}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section, o) - 1 AS INTEGER) AS chunk_index, section_path, md5(content) AS digest
FROM pieces WHERE content <> ''""")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = sc.chunk_documents(table(spark, sf_dir, "documents"), max_tokens=MAX_TOKENS, overlap_tokens=OVERLAP_TOKENS)
    return chunks.select("doc_id", "chunk_index", "section_path", F.md5("content").alias("digest"))


# Front matter as the tables have it: a title line and a list of tags.
_FRONT = r"""m AS (SELECT *, regexp_matches(text, '^---\r?\n(?s:.*?)\r?\n---\r?\n') AS marked FROM documents),
fm AS (SELECT *, CASE WHEN marked THEN regexp_extract(text, '^---\r?\n(.*?)\r?\n---\r?\n(.*)$', 1, 's') END AS head, CASE WHEN marked THEN regexp_extract(text, '^---\r?\n(.*?)\r?\n---\r?\n(.*)$', 2, 's') ELSE text END AS body FROM m),
fr AS (SELECT *, nullif(regexp_extract(head, '(?m)^title: *(.*?) *$', 1), '') AS said, CASE WHEN regexp_matches(head, '(?m)^tags: *\[') THEN array_to_string([trim(x) for x in string_split(regexp_extract(head, '(?m)^tags: *\[(.*)\]', 1), ',')], ',') END AS listed FROM fm)"""


@query(f"WITH {_FRONT} SELECT doc_id, said AS title, listed AS tags, NULL::VARCHAR AS expires_at, length(body) AS body_chars FROM fr")
def parse_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("note.md").alias("path"), "text")
    return fs.with_frontmatter(docs).select("doc_id", "title", "tags", "expires_at", F.length("body").cast("bigint").alias("body_chars"))


_PROCESSED = f"""{_FRONT}, named AS (SELECT concat_ws('#', path, doc_id) || '.md' AS doc_id, body, said, listed, modified_at FROM fr WHERE text IS NOT NULL),
{_packed("d AS (SELECT doc_id, string_split(body, chr(10)) AS ls FROM named)", 500, 100)},
ch AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section, o) - 1 AS INTEGER) AS chunk_index, section_path, content, max(section_path) OVER (PARTITION BY doc_id) AS deepest FROM pieces WHERE content <> ''),
pl AS (SELECT doc_id, string_split(doc_id, '/') AS parts FROM named), bl AS (SELECT doc_id, CASE WHEN parts[1] = 'data' THEN parts[2:] ELSE parts END AS below FROM pl),
nm AS (SELECT doc_id, list_filter([{sql_clean('x')} for x in list_append(below[1:len(below) - 1], {sql_stem('doc_id')})], lambda y: y <> '') AS names FROM bl),
hd AS (SELECT doc_id, list_filter([{sql_trim('x')} for x in string_split(body, chr(10))[1:10]], lambda y: starts_with(y, '# ')) AS heads FROM named)"""


@query(f"""WITH RECURSIVE {_PROCESSED}
SELECT doc_id, chunk_index, sha256(content) AS content_hash, 'misc' AS category, CASE WHEN deepest = '' THEN array_to_string(CASE WHEN len(names) > 2 THEN names[3:] ELSE names END, ' > ') ELSE section_path END AS section_path,
coalesce(said, {sql_trim('substring(heads[1], 3)')}, nullif({sql_clean(sql_stem('doc_id'))}, ''), {sql_stem('doc_id')}) AS title, coalesce(listed, '') AS tags,
strftime(modified_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS date_modified, CASE WHEN len(regexp_extract_all(substring(content, 1, 500), '[가-힣]')) > 10 THEN 'ko' ELSE 'en' END AS language
FROM ch JOIN named USING (doc_id) JOIN nm USING (doc_id) JOIN hd USING (doc_id)""")
def process_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter, sections, chunks and derived metadata of every document, those without a path included."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select(F.concat(F.concat_ws("#", "path", "doc_id"), F.lit(".md")).alias("path"), "text", "modified_at")
    out = sc.process_files(fs.with_frontmatter(docs).select(F.col("path").alias("doc_id"), F.col("body").alias("text"), "title", "tags", "expires_at", "modified_at"))
    return out.select("doc_id", "chunk_index", "content_hash", "category", "section_path", "title", F.array_join("tags", ",").alias("tags"), F.date_format("date_modified", "yyyy-MM-dd").alias("date_modified"), "language")


@query(rf"""WITH t AS (SELECT doc_id, '# ' || coalesce(title, '') || chr(10) || chr(10) || text AS t FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, array_to_string([regexp_replace(x, '{BLANK}+$', '') for x in string_split(t, chr(10))], chr(10)) AS t FROM t),
p AS (SELECT doc_id, {sql_trim("regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g')")} AS t FROM r)
SELECT doc_id || '.html' AS path, length(t) AS chars, md5(t) AS digest FROM p""")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document dressed as a web page and converted back to markdown."""
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<html><head><title>x</title><style>p {}</style></head><body><h1>"), F.coalesce("title", F.lit("")), F.lit("</h1><pre>"), escaped, F.lit("</pre></body></html>"))
    docs = table(spark, sf_dir, "documents").filter("text is not null").select(F.concat("doc_id", F.lit(".html")).alias("path"), F.encode(page, "utf-8").alias("content"))
    return fs.convert(docs).select("path", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))


@query()
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File discovery over the folder of the tables themselves; tests run it over the nine kinds of notes."""
    return fs.scan_files(spark, sf_dir, ("parquet",)).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")


def _hits(words: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"len(list_filter(ts, lambda t: t IN ({listed})))"


@query(f"""WITH t AS (SELECT doc_id, {sql_tokens('substring(text, 1, 2000)')} AS ts FROM documents),
s AS (SELECT doc_id, unnest([{', '.join(f"{{'n': {_hits(ws)}, 'c': '{c}'}}" for c, ws in CATEGORY_WORDS.items())}]) AS s FROM t)
SELECT doc_id, CASE WHEN max(s.n) > 0 THEN arg_min(s.c, (-s.n, s.c)) ELSE 'misc' END AS category FROM s GROUP BY doc_id""")
def classify_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")

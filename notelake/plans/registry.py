"""Where queries and their SQL twins are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) under its name, with the SQL that DuckDB answers alike."""

    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


#: The time at which expiry is judged in the registered queries.
NOW = "2025-01-01 00:00:00"

#: One row per key of chunks, as operators.store.current picks it.
CUR = """cur AS (SELECT * EXCLUDE (_r) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_index
    ORDER BY date_modified DESC NULLS LAST, archived_at DESC NULLS LAST, expires_at DESC NULLS LAST,
    archive_reason DESC NULLS LAST, array_to_string(tags, ',') DESC NULLS LAST) AS _r FROM chunks) WHERE _r = 1)"""

VISIBLE = f"(archived_at IS NULL AND (expires_at IS NULL OR expires_at > TIMESTAMPTZ '{NOW}+00'))"

BLANK = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def sql_tokens(c: str) -> str:
    return rf"coalesce(list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{Nd}}]+'), lambda t: t <> ''), [])"


def sql_trim(c: str) -> str:
    return f"regexp_replace({c}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def sql_clean(c: str) -> str:
    bare = rf"regexp_replace({c}, '^[0-9]+(?:\.[0-9]+)*(?:[_\-.]|{BLANK})*', '')"
    return sql_trim(f"regexp_replace(translate({bare}, '_-', '  '), '{BLANK}+', ' ', 'g')")


def sql_stem(c: str) -> str:
    last = f"list_extract(string_split({c}, '/'), -1)"
    return rf"regexp_replace({last}, '^(.+)\.[^.]*$', '\1')"


def sql_slug(c: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({sql_trim(c)}), '{BLANK}+', ' ', 'g'), '[^\p{{L}}\p{{N}}_ 가-힣·\-]', '', 'g')"


def sql_count_tokens(c: str) -> str:
    return rf"coalesce(len(regexp_extract_all({c}, '[\p{{L}}\p{{Nd}}]+|[^\p{{L}}\p{{Nd}}\s\x{{b}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]')), 0)"

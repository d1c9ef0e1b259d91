"""Text expressions: everything here is built-in Spark SQL and runs inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions that are ingested; the first two may carry front matter.
EXTENSIONS = ("md", "markdown", "txt", "pdf", "docx", "pptx", "xlsx", "html", "htm")
# Categories that a folder below data/ names.
CATEGORIES = ("about", "career", "study", "writing")
DEFAULT_CATEGORY = "misc"
ARROW = " > "
#: White space of any kind, as a character class that Java and RE2 read alike.
BLANK = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Without white space of any kind at the ends (``trim`` takes blanks only)."""
    return F.regexp_replace(column(c), f"^{BLANK}+|{BLANK}+$", "")


def tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters and digits, in order; null gives an empty list."""
    return F.coalesce(F.filter(F.split(F.lower(column(c)), r"[^\p{L}\p{Nd}]+"), lambda t: t != ""), F.array().cast("array<string>"))


def token_count(c: Column | str) -> Column:
    """Words and single marks: the offline stand-in for a tokenizer's length; null counts 0."""
    return F.coalesce(F.regexp_count(column(c), F.lit(r"[\p{L}\p{Nd}]+|[^\p{L}\p{Nd}\s\x{b}\x{1c}-\x{1f}\x{85}\p{Z}]")), F.lit(0)).cast("int")


def content_hash(c: Column | str) -> Column:
    return F.sha2(column(c), 256)


def detect_language(c: Column | str) -> Column:
    """'ko' if more than ten of the first 500 characters are Hangul syllables, else 'en'."""
    return F.when(F.regexp_count(F.substring(column(c), 1, 500), F.lit("[가-힣]")) > 10, "ko").otherwise("en")


def clean_name(c: Column | str) -> Column:
    """A readable path part: numbering in front dropped, separators to blanks, blanks collapsed."""
    bare = F.regexp_replace(column(c), r"^[0-9]+(?:\.[0-9]+)*(?:[_\-.]|" + BLANK + ")*", "")
    return trimmed(F.regexp_replace(F.translate(bare, "_-", "  "), f"{BLANK}+", " "))


def stem(c: Column | str) -> Column:
    """The last part of a path without its extension; a leading dot does not start an extension."""
    return F.regexp_replace(F.element_at(F.split(column(c), "/"), -1), r"(?<=.)\.[^.]*$", "")


def extension(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(F.element_at(F.split(column(c), "/"), -1), r"(?<=.)\.([^.]+)$", 1))


def derive_section(path: Column | str) -> Column:
    """Section path of a file without headings, from its place: the last folders and the stem, cleaned."""
    parts = F.split(column(path), "/")
    below = F.when(parts[0] == "data", F.slice(parts, 2, F.size(parts))).otherwise(parts)
    folders = F.slice(below, 1, F.greatest(F.size(below) - 1, F.lit(0)))
    named = F.filter(F.transform(F.concat(folders, F.array(stem(path))), clean_name), lambda n: n != "")
    return F.array_join(F.when(F.size(named) > 2, F.slice(named, 3, F.size(named))).otherwise(named), ARROW)


def derive_category(path: Column | str) -> Column:
    """The folder below data/ if it is one of CATEGORIES, else the default."""
    first = F.regexp_extract(column(path), r"^data/([^/]+)", 1)
    return F.when(first.isin(*CATEGORIES), first).otherwise(DEFAULT_CATEGORY)


def extract_title(text: Column | str, path: Column | str) -> Column:
    """The first level-one heading in the first ten lines, else the cleaned stem, else the stem."""
    head = F.transform(F.slice(F.split(column(text), "\n"), 1, 10), trimmed)
    headings = F.transform(F.filter(head, lambda x: x.startswith("# ")), lambda x: trimmed(F.substring(x, 3, 1 << 30)))
    cleaned = clean_name(stem(path))
    return F.coalesce(F.get(headings, F.lit(0)), F.when(cleaned != "", cleaned).otherwise(stem(path)))


def parse_expiry(c: Column | str) -> Column:
    """An ISO date or time as timestamp (a date is its midnight), else null."""
    v = column(c)
    iso = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}(:[0-9]{2}(:[0-9]{2}(\.[0-9]{3}([0-9]{3})?)?)?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"
    hour_only = r"^(.{10})[T ]([0-9]{2})(Z|[+-][0-9]{2}:[0-9]{2})?$"
    compact = F.regexp_replace(v, r"^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1-$2-$3")
    full = F.regexp_replace(compact, hour_only, "$1T$2:00$3")
    return F.when(compact.rlike(iso), F.try_to_timestamp(full))


def normalize_tags(c: Column | str) -> Column:
    """A comma-separated string as a list of trimmed, non-empty tags; null as an empty list."""
    return F.coalesce(F.filter(F.transform(F.split(column(c), ","), trimmed), lambda t: t != ""), F.array().cast("array<string>"))


def tag_list(c: Column | str) -> Column:
    """A list of tags for comparison: sorted, null as empty."""
    return F.array_sort(F.coalesce(column(c), F.array().cast("array<string>")))


def slug(c: Column | str) -> Column:
    """Trimmed, lower-cased, blanks collapsed, then only letters, numbers, '_', blanks, Hangul, '·' and '-' kept."""
    return F.regexp_replace(F.regexp_replace(F.lower(trimmed(c)), f"{BLANK}+", " "), r"[^\p{L}\p{N}_ 가-힣·\-]", "")


def embedding_text(name: Column | str, description: Column | str) -> Column:
    """'name: description' without colons and blanks at the ends."""
    both = F.concat(F.coalesce(column(name), F.lit("")), F.lit(": "), F.coalesce(column(description), F.lit("")))
    return F.regexp_replace(both, "^[: ]+|[: ]+$", "")

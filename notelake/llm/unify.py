"""One consistent form for text that looks the same but is written with different characters."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Greek and Cyrillic letters of the same shape as a Latin letter, in the order of their blocks.
SAME_SHAPE = {
    # Greek
    "Ϳ": "J", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "Ϝ": "F",
    "ϲ": "c", "ϳ": "j", "Ϸ": "Þ", "ϸ": "þ", "Ϲ": "C", "Ϻ": "M",
    # Cyrillic
    "Ѕ": "S", "І": "I", "Ј": "J", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ј": "j", "Ѵ": "V", "ѵ": "v", "Ү": "Y", "ү": "y", "һ": "h", "Ӏ": "I", "ӏ": "l", "Ӕ": "Æ",
    "ӕ": "æ", "Ә": "Ə", "ә": "ə", "Ӡ": "Ʒ", "ӡ": "ʒ", "Ө": "Ɵ", "ө": "ɵ", "ԁ": "d", "Ԍ": "G", "Ԑ": "Ɛ", "ԑ": "ɛ",
    "Ԛ": "Q", "ԛ": "q", "Ԝ": "W", "ԝ": "w",
}

# Hyphens drawn like the ASCII one.
HYPHENS = "‐‑﹣－"

# Ignorable code points that are not format characters (category Cf).
BLANK_LETTERS = "͏ᅟᅠ឴឵ㅤﾠ"

# Format characters that do show something.
SHOWN_FORMAT = "؀؁؂؃؄؅۝܏࢐࢑࣢"

#: Compatibility forms that differ only in width, joined letters or line breaking; raised, circled or
#: fractional forms look different and stay.
_SAME_LOOK_TAGS = ("<wide>", "<narrow>", "<noBreak>")


def _ignorable(char: str) -> bool:
    point = ord(char)
    if char in BLANK_LETTERS or 0xFE00 <= point <= 0xFE0F or 0xE0100 <= point <= 0xE01EF or 0x180B <= point <= 0x180F:
        return True
    return unicodedata.category(char) == "Cf" and char not in SHOWN_FORMAT


@lru_cache(maxsize=65536)
def _plain(char: str) -> str:
    """The characters that stand for ``char`` before accents are taken apart."""
    if _ignorable(char):
        return ""
    if unicodedata.category(char) == "Zs" or char == "\t":
        return " "
    if char in HYPHENS:
        return "-"
    tag, _, parts = unicodedata.decomposition(char).partition(" ")
    joined = tag == "<compat>" and "LIGATURE" in unicodedata.name(char, "")
    if tag in _SAME_LOOK_TAGS or joined:
        return "".join(_plain(chr(int(p, 16))) for p in parts.split())
    return char


def same_look(text: str | None) -> str | None:
    """The form shared by all spellings of ``text`` that read the same on screen.

    Width forms, joined letters, blanks, hyphens, composition and Greek or Cyrillic letters of Latin shape
    are unified and characters that show nothing vanish. Case, accents and raised digits stay. None stays
    None, '' stays ''; text of invisible characters only becomes ''.
    """
    if text is None or text.isascii():
        return text if text is None else text.replace("\t", " ")
    apart = unicodedata.normalize("NFD", "".join(map(_plain, text)))
    return unicodedata.normalize("NFC", "".join(SAME_SHAPE.get(c, c) for c in apart if not _ignorable(c)))


def comparison_form(text: str | None) -> str | None:
    """Looser than :func:`same_look`: full compatibility composition and full case folding on top of it."""
    if text is None:
        return None
    folded = unicodedata.normalize("NFKC", same_look(text)).casefold()
    return unicodedata.normalize("NFKC", folded)


_FORMS = {"look": same_look, "compare": comparison_form}


def unify(column: Column | str, form: str = "look") -> Column:
    """``column`` in one consistent form; each distinct value of a batch is worked out once."""
    function = _FORMS[form]

    @F.pandas_udf("string")
    def forms(values: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(values)
        done = [function(v) for v in distinct] + [None]
        return pd.Series([done[c] for c in codes], index=values.index, dtype=object)

    return forms(F.col(column) if isinstance(column, str) else column)


def value_forms(df: DataFrame, column: str, form: str = "look") -> DataFrame:
    """``value, form``: each distinct value of ``column`` with its consistent form; nulls have no row."""
    values = df.select(F.col(column).cast("string").alias("value")).filter("value is not null").distinct()
    return values.withColumn("form", unify("value", form))


#: Spellings of one form that a task pairs with all others of the form; a form with more of them is spread over several tasks.
SPELLINGS_PER_TASK = 500


def lookalikes(df: DataFrame, column: str, per_task: int = SPELLINGS_PER_TASK) -> DataFrame:
    """``value_a, value_b``: each pair of different values of ``column`` with the same look, value_a < value_b.

    Values meet by :func:`comparison_form` (compatibility composition and full case folding); of what meets,
    pairs that differ visibly, such as by case or a raised digit, are told apart by :func:`same_look`. Forms
    held by one value only are dropped on the aggregated side. The values of a form with many spellings are
    dealt out by hash, each share meeting all of them, so no task has more than ``per_task`` times their number.
    """
    values = value_forms(df, column, "compare").withColumnRenamed("form", "block")
    blocks = values.groupBy("block").agg(F.count("*").alias("n")).filter("n > 1").withColumn("shares", F.ceil(F.col("n") / per_task).cast("int")).drop("n")
    kept = values.join(blocks, "block").withColumn("look", unify("value"))
    own = kept.select("block", "look", F.pmod(F.xxhash64("value"), F.col("shares")).cast("int").alias("share"), F.col("value").alias("value_a"))
    others = kept.select("block", "look", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("value").alias("value_b"))
    return own.join(others, ["block", "look", "share"]).filter("value_a < value_b").select("value_a", "value_b")

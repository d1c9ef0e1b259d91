"""SQL twins of the queries that SQL can express over whole tables.

The language models, hash indexes, tokenizers and profiles behind the other queries have no SQL form; those
are tested against brute force, round trips and held-out accuracy in tests/llm.
"""

from __future__ import annotations

import unicodedata

# Fixed values of the SQL twins, stated on their own so that a hole in the operator's tables shows: letters of
# Latin shape and what they look like, hyphens, ignorable code points outside the class of format characters.
GREEK_SHAPES = ("ͿΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυϜϲϳϷϸϹϺ", "JABEZHIKMNOPTYXaivopuFcjÞþCM")
CYRILLIC_SHAPES = ("ЅІЈАВЕКМНОРСТУХаеорсухѕіјѴѵҮүһӀӏӔӕӘәӠӡӨөԁԌԐԑԚԛԜԝ", "SIJABEKMHOPCTYXaeopcyxsijVvYyhIlÆæƏəƷʒƟɵdGƐɛQqWw")
HYPHENS = "\u2010\u2011\ufe63\uff0d"
BLANK_LETTERS = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0"
BLANK = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\p{Z}]"

P1 = r"""SELECT DISTINCT doc_id, chunk_index, CASE WHEN list_max([length(x) for x in string_split(regexp_replace(
regexp_replace(content, '\n', chr(10) || chr(1), 'g'), '([.!?。！？])([ \t\r\n])', '\1' || chr(1) || '\2', 'g'), chr(1))]) > 1200 THEN 'forced' ELSE 'natural' END AS cut_kind
FROM chunks WHERE length(content) > 1200"""


def _translations() -> tuple[str, str]:
    """Single characters and what they become: width forms, letters of Latin shape with and without accents, hyphens."""
    shapes = dict(zip(*GREEK_SHAPES, strict=True)) | dict(zip(*CYRILLIC_SHAPES, strict=True))
    pairs = shapes | dict.fromkeys(HYPHENS, "-")
    for point in [*range(0x370, 0x530), *range(0x1F00, 0x2000), *range(0x3000, 0x3100), *range(0xFF00, 0xFFEF)]:
        char = chr(point)
        tag, _, parts = unicodedata.decomposition(char).partition(" ")
        if tag in ("<wide>", "<narrow>", "<noBreak>") and " " not in parts:
            pairs.setdefault(char, chr(int(parts, 16)))
        apart = unicodedata.normalize("NFD", char)
        joined = unicodedata.normalize("NFC", "".join(shapes.get(c, c) for c in apart))
        if joined not in (char, apart) and len(joined) == 1:
            pairs.setdefault(char, joined)
    keys = sorted(pairs)
    return "".join(keys), "".join(pairs[k] for k in keys)


def _same_look(c: str) -> str:
    old, new = _translations()
    bare = rf"regexp_replace({c}, '[{BLANK_LETTERS}\x{{fe00}}-\x{{fe0f}}\x{{180b}}-\x{{180f}}\x{{e0100}}-\x{{e01ef}}]|\p{{Cf}}', '', 'g')"
    spaced = rf"regexp_replace({bare}, '[\p{{Zs}}\t]', ' ', 'g')"
    for joined in "ﬀﬁﬂﬃﬄﬅﬆ":
        spaced = f"replace({spaced}, '{joined}', '{unicodedata.normalize('NFKC', joined)}')"
    return f"nfc_normalize(translate(nfc_normalize({spaced}), '{old.replace(chr(39), chr(39) * 2)}', '{new.replace(chr(39), chr(39) * 2)}'))"



P2_VALUES = f"""v AS (SELECT 'slug' AS field, slug AS value FROM concepts UNION SELECT 'alias_slug', alias_slug FROM concept_aliases UNION SELECT 'doc_id', doc_id FROM chunks),
f AS (SELECT field, value, {_same_look('value')} AS form FROM v WHERE value IS NOT NULL)"""
P2_FOUND = f"WITH {P2_VALUES} SELECT a.field, a.value AS value_a, b.value AS value_b FROM f a JOIN f b ON a.field = b.field AND a.form = b.form AND a.value < b.value"
P2_FORMS = f"WITH {P2_VALUES} SELECT field, value, form FROM f"

P4 = f"""WITH c AS (SELECT DISTINCT doc_id, chunk_index, list_filter(regexp_split_to_array(lower(content), '{BLANK}+'), lambda x: x <> '') AS w FROM chunks),
k AS (SELECT doc_id, chunk_index, list_distinct([array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)]) AS s FROM c WHERE len(w) >= 20),
e AS (SELECT doc_id, chunk_index, len(s) AS n, unnest(s) AS g FROM k),
p AS (SELECT a.doc_id AS doc_id_a, a.chunk_index AS chunk_index_a, b.doc_id AS doc_id_b, b.chunk_index AS chunk_index_b, a.n AS na, b.n AS nb, count(*) AS shared
  FROM e a JOIN e b ON a.g = b.g AND (a.doc_id, a.chunk_index) < (b.doc_id, b.chunk_index) AND least(a.n, b.n) >= 0.6 * greatest(a.n, b.n) GROUP BY ALL)
SELECT doc_id_a, chunk_index_a, doc_id_b, chunk_index_b FROM p WHERE shared >= 0.6 * (na + nb - shared)"""

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(chr(p - 0xFEE0) for p in range(0xFF01, 0xFF5F)).replace("'", "''")
_WORDS = r"regexp_extract_all(lower(nfc_normalize(translate(replace(replace({0}, 'ﬁ', 'fi'), 'ﬂ', 'fl'), '{1}', '{2}'))), '[\p{{L}}\p{{N}}]+')"
P6 = f"""WITH d AS (SELECT DISTINCT doc_id, {_WORDS.format('text', _WIDE, _NARROW)} AS w FROM documents WHERE text <> ''),
i AS (SELECT DISTINCT item_id, {_WORDS.format('text', _WIDE, _NARROW)} AS w FROM eval_passages WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[j:j + 12], ' ') for j in range(1, len(w) - 11)]) AS g FROM d WHERE len(w) >= 13),
ig AS (SELECT DISTINCT item_id, unnest([array_to_string(w[j:j + 12], ' ') for j in range(1, len(w) - 11)]) AS g FROM i WHERE len(w) >= 13)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"""

# Tokens have no SQL form, but the answer does not hang on the tokenizer: bytes of text are as good a measure.
P7 = """WITH o AS (SELECT lower(trim(source)) AS source, sum(strlen(text)) AS size FROM (SELECT DISTINCT doc_id, source, text FROM documents) GROUP BY 1),
t AS (SELECT lower(trim(source)) AS source, sum(target_share) AS target_share, max(max_repeats) AS max_repeats FROM source_targets GROUP BY 1),
k AS (SELECT t.*, coalesce(size, 0) AS size, sum(coalesce(size, 0)) OVER () AS total FROM t LEFT JOIN o USING (source))
SELECT source FROM k WHERE max_repeats * size < target_share * total"""

ORACLES: dict[str, str] = {"p1_found": P1, "p2_found": P2_FOUND, "p2_forms": P2_FORMS, "p4_found": P4, "p6_found": P6, "p7_found": P7}

"""Parsers of what language models answer, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys that models give to the slots of a triple.
SUBJECT_KEYS = ("subject", "subj", "s", "विषय", "कर्ता")
RELATION_KEYS = ("predicate", "pred", "relation", "rel", "p", "verb", "विधेय", "क्रिया", "संबंध")
OBJECT_KEYS = ("object", "obj", "o", "वस्तु", "कर्म")
# Postpositions and copulas that are no value when they stand alone.
BARE_WORDS = ("में", "को", "से", "का", "के", "की", "है", "था", "थी", "थे")

_TRIPLES = "array<struct<s:string,r:string,o:string>>"
_SLOT = r"\s*([^,()\n]+?)\s*"


def json_block(c: Column) -> Column:
    """The first to the last brace or bracket of an answer, without code fences; null where there is none."""
    bare = F.regexp_replace(c, r"```(?:json)?", "")
    found = F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.when(found != "", found)


def json_list_triples(c: Column) -> Column:
    """Triples of the outermost list of lists: three non-empty slots of at most 200, 100 and 200 characters."""
    lists = F.from_json(F.replace(F.regexp_extract(c, r"(?s)(\[.*\])", 1), F.lit("'"), F.lit('"')), "array<array<string>>")
    whole = F.filter(F.coalesce(lists, F.array().cast("array<array<string>>")), lambda t: F.size(t) == 3)
    rows = F.transform(whole, lambda t: F.struct(F.trim(t[0]).alias("s"), F.trim(t[1]).alias("r"), F.trim(t[2]).alias("o")))
    fits = lambda x, n: F.length(x).between(1, n)
    return F.filter(rows, lambda t: fits(t["s"], 200) & fits(t["r"], 100) & fits(t["o"], 200))


def function_call(c: Column, name: str) -> Column:
    """Arguments (map) of the call of ``name`` that an answer holds; null for other answers and for bad JSON."""
    text = F.regexp_extract(c, r'(?s)(\{\s*"name":\s*"' + name + r'".*\})', 1)
    return F.from_json(F.when(text != "", text), "name string, arguments map<string,string>")["arguments"]


def _slot(row: Column, keys: tuple[str, ...]) -> Column:
    return F.trim(F.coalesce(*[F.element_at(row, k) for k in keys], F.lit("")))


def _lowered(row: Column) -> Column:
    return F.map_from_entries(F.transform(F.map_entries(row), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value"))))


def _made(rows: Column) -> Column:
    return F.transform(rows, lambda m: F.struct(_slot(m, SUBJECT_KEYS).alias("s"), _slot(m, RELATION_KEYS).alias("r"), _slot(m, OBJECT_KEYS).alias("o")))


def _json_objects(c: Column) -> Column:
    rows = F.transform(F.regexp_extract_all(c, F.lit(r"(\{[^{}]*\})"), F.lit(1)), lambda t: F.from_json(t, "map<string,string>"))
    return _made(F.transform(F.filter(rows, lambda m: m.isNotNull()), _lowered))


def _matched(c: Column, pattern: str) -> Column:
    part = lambda k: F.regexp_extract_all(c, F.lit(pattern), F.lit(k))
    return F.transform(F.arrays_zip(part(1).alias("s"), part(2).alias("r"), part(3).alias("o")), lambda t: F.struct(F.trim(t["s"]).alias("s"), F.trim(t["r"]).alias("r"), F.trim(t["o"]).alias("o")))


def _commas(c: Column) -> Column:
    parts = F.split(c, r"\s*,\s*", -1)
    return F.when(F.size(parts) >= 3, F.array(F.struct(parts[0].alias("s"), parts[1].alias("r"), parts[2].alias("o")))).otherwise(F.array().cast(_TRIPLES))


def _value(c: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"""^["'\[(]+|["'\])]+$""", ""), r"\s+", " "))
    return F.when(bare.isin(*BARE_WORDS), "").otherwise(bare)


def answer_triples(c: Column) -> Column:
    """Struct (method, triples) of an answer: its JSON objects, else what one of the written forms has (brackets, arrows,
    numbered, named slots), else the first three parts between commas. Slots have 1 to 200 characters, without quotes and brackets."""
    text = F.trim(F.regexp_replace(c, r"\s+", " "))
    text = F.regexp_replace(text, r"^(?:JSON Output:|Output:|Triplets:|Relations:)\s*", "")
    named = r"(?i)subject[:\s]*([^\n,]+).*?relation[:\s]*([^\n,]+).*?object[:\s]*([^\n,]+)"
    written = [_matched(text, rf"\({_SLOT},{_SLOT},{_SLOT}\)"), _matched(text, r"\d+\.\s*([^\-\n]+?)\s*-\s*([^\-\n]+?)\s*-\s*([^\n]+)"), _matched(text, r"([^\->\n]+?)\s*->\s*([^\->\n]+?)\s*->\s*([^\n]+)"), _matched(text, named)]
    fine = lambda rows: F.filter(rows, lambda t: F.forall(F.array(t["s"], t["r"], t["o"]), lambda x: F.length(F.trim(x)).between(1, 200)))
    clean = lambda rows: F.transform(rows, lambda t: F.struct(*[_value(t[k]).alias(k) for k in "sro"]))
    ways = F.array(*[F.struct(F.lit(name).alias("method"), clean(fine(rows)).alias("triples")) for name, rows in (("json", _json_objects(text)), ("patterns", F.concat(*written)), ("fallback", _commas(text)))])
    failed = F.struct(F.lit("failed").alias("method"), F.array().cast(_TRIPLES).alias("triples"))
    return F.coalesce(F.get(F.filter(ways, lambda w: F.size(w["triples"]) > 0), F.lit(0)), failed)


def checked_answer(c: Column) -> Column:
    """Struct (triples, parse_error): a list under ``triples``, or one triple whose object may be ``object_``. Items without one of the
    slots go; the error says whether there was no JSON or no triple."""
    raw = F.regexp_extract(F.trim(F.regexp_replace(c, r"```(?:json)?", "")), r"(?s)(\{.*\})", 1)
    slots = "subject:string,predicate:string,object:string,object_:string"
    data = F.from_json(F.when(raw != "", raw), f"triples array<struct<{slots}>>, subject string, predicate string, object string, object_ string")
    item = lambda t: F.struct(t["subject"].alias("s"), t["predicate"].alias("r"), F.coalesce(t["object_"], t["object"]).alias("o"))
    found = F.coalesce(F.transform(data["triples"], item), F.array(item(data)))
    whole = F.filter(found, lambda t: t["s"].isNotNull() & t["r"].isNotNull() & t["o"].isNotNull())
    named = data["triples"].isNotNull() | data["subject"].isNotNull()
    error = F.when(data.isNull() | ~named, F.concat(F.lit("Could not parse JSON from: "), F.substring(c, 1, 200))).when(F.size(whole) == 0, F.concat(F.lit("No valid triples parsed from: "), F.substring(c, 1, 200)))
    return F.struct(F.when(error.isNull(), whole).otherwise(F.array().cast(_TRIPLES)).alias("triples"), error.alias("parse_error"))


def title_and_language(c: Column) -> Column:
    """Struct (title, lang) of ``title >> lang``; anything else is an English title as it is."""
    parts = F.transform(F.split(c, ">>", -1), lambda p: F.trim(p))
    two = (F.size(parts) == 2) & (parts[0] != "")
    return F.struct(F.when(two, parts[0]).otherwise(F.trim(c)).alias("title"), F.when(two, F.get(parts, F.lit(1))).otherwise("en").alias("lang"))


def without_marks(c: Column) -> Column:
    """Emoji and variation selectors go, a pipe becomes the danda that ends a Hindi sentence."""
    return F.replace(F.regexp_replace(F.regexp_replace(c, r"[\x{1F004}-\x{1FA95}]+", ""), r"[\x{FE00}-\x{FE0F}]+", ""), F.lit("|"), F.lit("।"))


def mail_date(c: Column) -> Column:
    """RFC-822 date as an ISO time in UTC; null where it is none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", ""), r"\b(?:GMT|UTC|UT)$", "+0000")
    return F.date_format(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), "yyyy-MM-dd'T'HH:mm:ss'Z'")

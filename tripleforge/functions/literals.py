"""Literal values in the form that a benchmark's gold has them, and lookup variants from a mention's sentence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import MONTHS, iso_date

# Predicates whose literals gold never quotes, date predicates without "date" at the end, units that go.
NEVER_QUOTED = ("areacode", "demonym", "foundingyear", "populationtotal", "areatotal", "elevation", "runwaylength")
DATE_PREDICATES = ("established", "foundingdate", "completiondate")
UNITS = ("feet", "foot", "ft", "metres", "meters", "m", "kilometres", "km", "inhabitants", "people")

# The kind that a page title has in parentheses, and the words of a sentence that speak of it.
KINDS = {
    "song": ("song", "single", "hit", "track"),
    "album": ("album", "lp", "ep"),
    "film": ("film", "movie"),
    "band": ("band", "group"),
    "novel": ("novel",),
    "book": ("book",),
    "comic": ("comic", "comics"),
    "director": ("director", "directed"),
    "actor": ("actor", "actress"),
    "singer": ("singer",),
    "writer": ("writer",),
    "musician": ("musician",),
}
CONNECTORS = ("of", "the", "and", "de", "la", "von", "van", "der")
MOST_NAMES, MOST_VARIANTS = 6, 16


def literal(raw: Column, predicate: Column, kind: Column, quote_hint: Column | None = None, date_style: Column | None = None) -> Column:
    """Struct (value, quoted) of a raw value. ``kind`` is the predicate's range (number, date, year, string), the hint whether gold
    quotes the predicate's values, the style whether its dates stay English. Text only: no value becomes a number, so leading zeros stay."""
    hint = F.coalesce(quote_hint, F.lit(False)) if quote_hint is not None else F.lit(False)
    style = F.coalesce(date_style, F.lit("")) if date_style is not None else F.lit("")
    pid, rng = F.lower(F.coalesce(predicate, F.lit(""))), F.lower(F.coalesce(kind, F.lit("")))
    value = F.trim(F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), '^"+|"+$', ""))
    english = F.lower(value).rlike(r"\b(" + "|".join(MONTHS) + r")\b") & ~value.contains("(")
    dated = (rng == "date") | pid.endswith("date") | pid.isin(*DATE_PREDICATES) | ((style == "iso") & english)
    iso = F.when(value.rlike(r"[A-Za-z]|^\d{1,2}[-/]"), iso_date(value)).otherwise(value)
    unitless = F.when(value.rlike(r"\([A-Za-z]"), value).otherwise(F.trim(F.regexp_replace(value, r"(?i)\b(" + "|".join(UNITS) + r")\b", "")))
    number = F.when(unitless.rlike(r"^[\d,]+(\.\d+)?$"), F.replace(unitless, F.lit(","), F.lit(""))).otherwise(unitless)
    bare = F.when((pid == "runwaylength") & number.rlike(r"^-?\d+$"), F.concat(number, F.lit(".0"))).when(pid.endswith("year") & number.rlike(r"^\d{1,3}$"), F.lpad(number, 4, "0")).otherwise(number)
    out = lambda v, quoted: F.struct(v.alias("value"), quoted.cast("boolean").alias("quoted"))
    return (
        F.when(dated & english & (style == "english"), out(value, F.lit(True)))
        .when(dated & english & iso_date(value).isNull(), out(value, F.lit(True)))
        .when(dated, out(F.coalesce(iso, value), hint & ~english))
        .when(pid.isin(*NEVER_QUOTED), out(bare, F.lit(False)))
        .when(rng == "number", out(number, hint))
        .when(rng == "year", out(F.when(value.rlike(r"^\d{1,3}$"), F.lpad(value, 4, "0")).otherwise(value), hint))
        .otherwise(out(value, hint | value.rlike("[, ]")))
    )


def routed(raw: Column, predicate: Column, quote_hint: Column | None = None) -> Column:
    """Struct (value, quoted) of an object that no entity stands for, where it looks like a value: a year of a ``...Year`` predicate, a sum of
    money, a date, or a number with or without a unit. Null for anything else, which stays a quoted name."""
    value = F.trim(F.regexp_replace(F.trim(raw), '^"+|"+$', ""))
    value = F.when(value.rlike(r"^(?:1[6-9]|20)\d{2}$") & predicate.endswith("Year"), F.concat(value, F.lit("-01-01"))).otherwise(value)
    value = F.when(value.rlike(r"^[$£€]\s*[\d,]+(?:\.\d+)?$"), F.regexp_replace(value, r"^[$£€]\s*", "")).otherwise(value)
    month = F.lower(value).rlike("|".join(MONTHS))
    dated = value.rlike(r"^(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{4})$") | (month & value.rlike(r"^(?:[A-Za-z]+ \d{1,2}(?:st|nd|rd|th)?,? \d{4}|\d{1,2}(?:st|nd|rd|th)? [A-Za-z]+,? \d{4})$"))
    number = value.rlike(r"^-?[\d,]+(?:\.\d+)?(?:\s*\(?[A-Za-z][A-Za-z/ .]{0,40}\)?)?$")
    # a date or number is what it looks like, whatever the predicate's name says
    return F.when(dated, literal(value, F.lit(""), F.lit("date"), quote_hint)).when(number, literal(value, predicate, F.lit("number"), quote_hint))


def context_variants(mention: Column, sentence: Column) -> Column:
    """Titles with a parenthesis that the sentence suggests: a year or a name and a kind, or the kind alone; at most MOST_VARIANTS."""
    said, title = F.coalesce(sentence, F.lit("")), F.trim(F.coalesce(mention, F.lit("")))
    word = r"[A-Z][\w.'&-]*"
    phrase = rf"\b({word}(?:\s+(?:{'|'.join(CONNECTORS)})\s+{word}|\s+{word}){{0,4}})"
    trimmed = F.transform(F.regexp_extract_all(said, F.lit(phrase), F.lit(1)), lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), "'s?$", ""), r"^[.,;:]+|[.,;:]+$", ""))
    both = F.flatten(F.transform(trimmed, lambda x: F.array(x, F.regexp_replace(x, r"^(?:The|A|An)\s+", ""))))
    names = F.slice(F.array_distinct(F.filter(both, lambda x: (x != "") & (F.lower(x) != F.lower(title)))), 1, MOST_NAMES)
    year = F.regexp_extract(said, r"\b((?:18|19|20)\d{2})\b", 1)
    kinds = F.filter(F.array(*[F.when(said.rlike(rf"(?i)\b(?:{'|'.join(t)})s?\b"), F.lit(k)) for k, t in KINDS.items()]), lambda k: k.isNotNull())

    def titled(n: Column, y: Column) -> Column:
        made = lambda k: F.concat(F.when(y != "", F.array(F.concat(y, F.lit(" "), k))).otherwise(F.array().cast("array<string>")), F.transform(n, lambda x: F.concat(x, F.lit(" "), k)), F.array(k))
        return F.transform(F.flatten(F.transform(kinds, made)), lambda q: F.concat(title, F.lit(" ("), q, F.lit(")")))

    variants = F.slice(F.element_at(F.transform(F.array(F.struct(names.alias("n"), year.alias("y"))), lambda b: titled(b["n"], b["y"])), 1), 1, MOST_VARIANTS)
    return F.when((title == "") | title.startswith('"'), F.array().cast("array<string>")).otherwise(variants)

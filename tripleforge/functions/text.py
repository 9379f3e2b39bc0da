"""Text normalisers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RESOURCE = "http://kg.example.org/resource/"
ONTOLOGY = "http://kg.example.org/ontology/"
COPULAS = ("is", "are", "was", "were", "be", "has", "have")
FUNCTION_WORDS = ("the", "a", "an", "of", "in", "on", "is", "was", "and", "to")


def normalize(c: Column) -> Column:
    """Collapse white space, strip, lower-case: the key of the surface index and of its lookups."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def percent_decoded(c: Column) -> Column:
    """Percent-decode only where a % is present; ``+`` stays, malformed escapes leave the text as it is."""
    return F.when(c.contains("%"), F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)).otherwise(c)


def local_name(uri: Column) -> Column:
    """Decoded rest after the resource prefix; empty for other URIs."""
    return F.when(F.startswith(uri, F.lit(RESOURCE)), percent_decoded(F.substring(uri, len(RESOURCE) + 1, 1 << 20))).otherwise("")


def last_segment(c: Column) -> Column:
    """Text after the last slash, angle brackets stripped."""
    return F.regexp_extract(F.regexp_replace(c, r"^<|>$", ""), r"([^/]*)$", 1)


def fragment_name(uri: Column) -> Column:
    """After ``#``, else after the last slash that isn't at the end."""
    return F.when(uri.contains("#"), F.regexp_extract(uri, r"#([^#]*)$", 1)).otherwise(F.regexp_extract(F.regexp_replace(uri, r"/+$", ""), r"([^/]*)$", 1))


def split_camel(c: Column) -> Column:
    """Space between a lower-case letter or digit and a capital, ``_`` to space."""
    return F.regexp_replace(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2"), "_", " ")


def split_camel_words(c: Column) -> Column:
    """Separators and camel case to single spaces, lower-case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[_.\-]", " "), r"([a-z0-9])([A-Z])", "$1 $2"), r"\s+", " ")))


def space_capitals(c: Column) -> Column:
    """Space before every capital that isn't the first character."""
    return F.regexp_replace(c, r"(?<!^)([A-Z])", " $1")


def label_text(uri: Column, label: Column, comment: Column) -> Column:
    return F.concat_ws(". ", F.concat(F.lit("predicate: "), fragment_name(uri)), F.concat(F.lit("label: "), label), F.concat(F.lit("comment: "), comment))


def triple_key(sub: Column, rel: Column, obj: Column) -> Column:
    """Slots without ``_`` and white space, lower-cased, put together without separator: what the metric compares."""
    return F.concat(*[F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[_\s]", "")) for c in (sub, rel, obj)])


def surface_variants(c: Column) -> Column:
    """Distinct spellings in the order in which a lookup tries them."""
    bare = F.trim(F.regexp_replace(c, r"^[^\w]+|[^\w]+$", ""))
    no_dot = lambda x: F.replace(x, F.lit("."), F.lit(""))
    no_dash = lambda x: F.replace(x, F.lit("-"), F.lit(" "))
    bases = F.array_distinct(F.array(*[f(x) for x in (c, bare) for f in (lambda x: x, no_dot, no_dash, lambda x: no_dash(no_dot(x)))]))
    forms = F.flatten(F.transform(bases, lambda x: F.array(x, F.replace(x, F.lit(" "), F.lit("_")), F.replace(x, F.lit("_"), F.lit(" ")), F.regexp_replace(x, "(?i)^the ", ""))))
    return F.array_distinct(F.filter(F.transform(forms, normalize), lambda x: x != ""))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def main_text(html: Column) -> Column:
    """Visible text: scripts, styles and page furniture dropped with their content, then all tags."""
    dropped = F.regexp_replace(html, r"(?is)<(script|style|header|footer|nav|aside)\b[^>]*>.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(dropped, "<[^>]+>", " "), r"\s+", " "))


def clean_snippet(c: Column, limit: int = 900) -> Column:
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, limit)


def annotate_span(sentence: Column, start: Column, end: Column) -> Column:
    """Mark [start, end) with the markers of a span linker."""
    return F.concat(F.substring(sentence, F.lit(1), start), F.lit("[START] "), F.substring(sentence, start + 1, end - start), F.lit(" [END]"), F.substring(sentence, end + 1, F.length(sentence)))


def annotate_mention(sentence: Column, mention: Column) -> Column:
    """Mark the first occurrence, whatever its case; null where there is none."""
    at = F.position(F.lower(mention), F.lower(sentence))
    return F.when(at > 0, annotate_span(sentence, at - 1, at - 1 + F.length(mention)))


def is_copula(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(*COPULAS)


def ascii_letter_ratio(c: Column) -> Column:
    """ASCII letters among all letters; 0 where there is no letter."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(c, "[^A-Za-z]", "")) / letters).otherwise(0.0)


def mixes_languages(c: Column, ratio: float = 0.65) -> Column:
    words = F.split(F.lower(c), r"[^\p{L}]+", -1)
    return (ascii_letter_ratio(c) > ratio) | F.arrays_overlap(words, F.array(*[F.lit(w) for w in FUNCTION_WORDS]))


def slug(triples: Column) -> Column:
    """One ``s|r|o`` line a triple; without subject or relation it goes, an empty object is NONE, nothing at all too."""
    rows = F.filter(triples, lambda t: (F.trim(F.coalesce(t["s"], F.lit(""))) != "") & (F.trim(F.coalesce(t["r"], F.lit(""))) != ""))
    lines = F.transform(rows, lambda t: F.concat_ws("|", F.trim(t["s"]), F.trim(t["r"]), F.when(F.trim(F.coalesce(t["o"], F.lit(""))) == "", "NONE").otherwise(F.trim(t["o"]))))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise("NONE")


def slug_valid(c: Column, strict: bool = False) -> Column:
    """Each non-blank line has two pipes; strict: NONE, or three non-blank parts a line."""
    lines = F.filter(F.split(c, "\n", -1), lambda x: F.trim(x) != "")
    if strict:
        return (F.trim(c) == "NONE") | ((F.size(lines) > 0) & F.forall(lines, lambda x: (F.size(F.split(x, r"\|", -1)) == 3) & F.forall(F.split(x, r"\|", -1), lambda p: F.trim(p) != "")))
    return F.forall(lines, lambda x: F.size(F.split(x, r"\|", -1)) == 3)


def slug_triples(c: Column) -> Column:
    parts = F.transform(F.split(c, "\n", -1), lambda x: F.transform(F.split(x, r"\|", -1), lambda p: F.trim(p)))
    return F.filter(parts, lambda p: (F.size(p) == 3) & F.forall(p, lambda x: x != ""))


def tokens(c: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))


def final_answer(c: Column) -> Column:
    """Text after the last [ANSWER] marker."""
    return F.trim(F.element_at(F.split(c, r"\[ANSWER\]", -1), -1))


def format_object(resolved: Column, value: Column) -> Column:
    return F.when(resolved.isNotNull(), F.replace(resolved, F.lit(" "), F.lit("_"))).otherwise(F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit("")), F.lit('"')))


MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def iso_date(c: Column) -> Column:
    """``Month D, YYYY``, ``D Month YYYY`` (ordinals too), ``DD-MM-YYYY`` (swapped where the first exceeds 12) as YYYY-MM-DD, years padded to four digits; else null."""
    text = F.regexp_replace(F.lower(F.trim(c)), r"(\d)(st|nd|rd|th)\b", "$1")
    named = F.array(*[F.lit(m) for m in MONTHS])
    two = lambda x: F.lpad(x, 2, "0")
    out = None
    for pattern, (month, day, year) in ((r"^([a-z]+) (\d{1,2}),? (\d{1,4})$", (1, 2, 3)), (r"^(\d{1,2}) ([a-z]+),? (\d{1,4})$", (2, 1, 3))):
        at = F.array_position(named, F.regexp_extract(text, pattern, month))
        value = F.concat_ws("-", F.lpad(F.regexp_extract(text, pattern, year), 4, "0"), two(at.cast("string")), two(F.regexp_extract(text, pattern, day)))
        out = F.when(text.rlike(pattern) & (at > 0), value) if out is None else out.when(text.rlike(pattern) & (at > 0), value)
    numeric = r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})$"
    a, b, y = (F.regexp_extract(text, numeric, k) for k in (1, 2, 3))
    swapped = F.try_to_number(b, F.lit("99")) > 12
    out = out.when(text.rlike(numeric), F.concat_ws("-", y, two(F.when(swapped, a).otherwise(b)), two(F.when(swapped, b).otherwise(a))))
    out = out.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)
    return out.when(text.rlike(r"^\d{1,4}$"), F.lpad(text, 4, "0"))


def sentences(c: Column) -> Column:
    """Stretches up to a full stop, question or exclamation mark (or several), trimmed, blanks collapsed; empty ones are left out."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([^.!?]*[.!?]+|[^.!?]+$)"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def shared_links(page: Column, base: Column) -> Column:
    """Links of a page that have one of the base's in them, or are in one, as they are or decoded."""
    fits = lambda x, y: F.contains(x, y) | F.contains(y, x) | F.contains(percent_decoded(y), percent_decoded(x))
    return F.filter(page, lambda x: F.exists(base, lambda y: fits(x, y)))


def listed(c: Column) -> Column:
    """Quoted items of a list that was written as text."""
    items = F.regexp_extract_all(c, F.lit(r"""('[^']*'|"[^"]*")"""), F.lit(1))
    return F.transform(items, lambda x: F.substring(x, F.lit(2), F.length(x) - 2))

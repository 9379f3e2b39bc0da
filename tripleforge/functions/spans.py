"""Mentions, spans, chunk tags and coreference as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import fragment_name

# Case markers of Hindi, pronouns that name nobody, demonstratives, and words that are no relation by themselves.
CASE_MARKERS = ("ने", "को", "से", "का", "की", "के", "में", "मे", "पर", "केलिए")
AMBIGUOUS_PRONOUNS = ("उन्होंने", "उसने", "इन्होंने", "इसे", "उसे", "उसका", "उसकी", "उसके", "इसका", "इसकी", "इसके", "उनका", "उनकी", "उनके")
DEMONSTRATIVES = ("यह", "वह", "ये", "वे")
RELATION_FILLERS = ("है", "हैं", "था", "थे", "थी", "थीं", "होगा", "होगी", "का", "के", "की", "को", "में", "ने", "से", "पर", "और", "of", "in", "is", "are", "was", "by", "to", "for")
# What a judge says of a triple that it does not really approve.
CONTRADICTIONS = ("should be", "incorrect", "is wrong", "hijack", "not correct", "invalid")


def _once(value: Column, f) -> Column:
    """``f`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def property_text(uri: Column, labels: Column, comment: Column) -> Column:
    """Labels between bars, else the local name; then the comment."""
    return F.concat_ws(" | ", F.when(F.size(labels) > 0, F.array_join(labels, " | ")).otherwise(fragment_name(uri)), comment)


def older_variants(c: Column) -> Column:
    """As it is, lower case, title case, and both of the outer ones with underscores."""
    title = F.initcap(c)
    return F.array_distinct(F.array(c, F.lower(c), title, F.replace(c, F.lit(" "), F.lit("_")), F.replace(title, F.lit(" "), F.lit("_"))))


def restored_initial(resolved: Column, mention: Column) -> Column:
    """``First_M._Last`` where the mention is ``First M. Last`` and the resolved name just lacks the initial."""
    pattern = r"^([A-Z][a-zA-Z\-]+)\s+([A-Z])\.?\s+([A-Z][a-zA-Z\-]+)$"
    part = lambda k: F.regexp_extract(F.trim(mention), pattern, k)
    dropped = F.trim(mention).rlike(pattern) & (resolved == F.concat_ws("_", part(1), part(3)))
    return F.when(dropped, F.concat(part(1), F.lit("_"), part(2), F.lit("._"), part(3))).otherwise(resolved)


def formatted_mentions(sentence: Column, mentions: Column) -> Column:
    """``[mention](#)`` for each mention; of those that begin at a place, the longest."""
    quoted = F.transform(mentions, lambda m: F.regexp_replace(m, r"([\\^$.|?*+()\[\]{}])", r"\\$1"))
    longest_first = F.array_sort(quoted, lambda a, b: F.length(b) - F.length(a))
    return F.when(F.size(mentions) > 0, F.regexp_replace(sentence, F.array_join(longest_first, "|"), F.lit("[$0](#)"))).otherwise(sentence)


def chains(c: Column) -> Column:
    """(chain, mentions) of ``[mention](#chain)`` links, chains in the order of their first mention."""

    def grouped(rows: Column) -> Column:
        names = F.array_distinct(F.transform(rows, lambda r: r["id"]))
        return F.transform(names, lambda n: F.struct(n.alias("chain"), F.transform(F.filter(rows, lambda r: r["id"] == n), lambda r: r["m"]).alias("mentions")))

    pattern = r"\[([^\]]+)\]\(#([^)]+)\)"
    found = F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)).alias("m"), F.regexp_extract_all(c, F.lit(pattern), F.lit(2)).alias("id"))
    return _once(found, grouped)


def resolved(sentence: Column, chain_list: Column) -> Column:
    """Each later mention of a chain replaced by its first one, chain by chain."""
    later = lambda chain: F.slice(chain, 2, F.greatest(F.size(chain) - 1, F.lit(0)))
    return F.aggregate(chain_list, sentence, lambda text, chain: F.aggregate(later(chain), text, lambda t, m: F.replace(t, m, chain[0])))


def without_case_marker(c: Column) -> Column:
    """A span without its last word where that is a case marker (or two words that are one), and without a vocative before it."""
    last = F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), r"(?:^| )(?:के लिए|" + "|".join(CASE_MARKERS) + ")$", "")
    return F.trim(F.regexp_replace(last, "^हे(?: |$)", ""))


def with_case_marker(c: Column, replaced: Column) -> Column:
    """A span with the case marker of the pronoun that it replaces; the second person is left as it is."""
    out = None
    for marker in CASE_MARKERS:
        fits = F.trim(replaced).endswith(marker) & ~F.trim(replaced).rlike("^(?:आ|अ)प") & (replaced != "इसे")
        value = F.concat(c, F.lit(" " + marker))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out.when(replaced.isin("उन्हें", "उन्हे", "इसे"), F.concat(c, F.lit(" को"))).when(replaced.startswith("आप"), replaced).otherwise(c)


def pronoun_verdict(c: Column) -> Column:
    """ambiguous: a pronoun, or a demonstrative alone; self_contained: a demonstrative before a noun; else none."""
    text = F.trim(F.coalesce(c, F.lit("")))
    first = F.regexp_extract(text, r"^(\S*)", 1)
    ambiguous = F.regexp_extract(text, "^([^ ]*)", 1).isin(*AMBIGUOUS_PRONOUNS) | text.isin(*DEMONSTRATIVES)
    return F.when(ambiguous, "ambiguous").when(first.isin(*DEMONSTRATIVES), "self_contained").otherwise("none")


def entry_pronoun_status(content: Column) -> Column:
    """ambiguous if a triple of the JSON content has an ambiguous subject or object, its relation not being ``property``."""
    rows = F.from_json(content, "extracted_triplets array<struct<subject:string,relation:string,object:string>>")["extracted_triplets"]
    core = F.filter(F.coalesce(rows, F.array().cast("array<struct<subject:string,relation:string,object:string>>")), lambda t: F.trim(F.coalesce(t["relation"], F.lit(""))) != "property")
    bad = F.exists(core, lambda t: (pronoun_verdict(t["subject"]) == "ambiguous") | (pronoun_verdict(t["object"]) == "ambiguous"))
    return F.when(bad, "ambiguous").otherwise("self_contained")


def notebook_error(relation: Column) -> Column:
    """Kind of a wrong extraction by its relation: mostly ASCII letters, one or two fillers, no ontology prefix, else its arguments."""
    text = F.trim(relation)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    english = F.when(letters > 0, F.length(F.regexp_replace(text, "[^A-Za-z]", "")) / letters).otherwise(0.0)
    words = F.filter(F.split(text, r"\s+", -1), lambda w: w != "")
    filler = (F.size(words) <= 2) & F.forall(words, lambda w: w.isin(*RELATION_FILLERS))
    return F.when(english > 0.6, "LANGUAGE_MIXING").when(filler, "IMPLICIT_RELATION").when(~text.startswith("dbo:"), "PREDICATE_NORMALIZATION").otherwise("ARGUMENT_SPAN")


def refines(wanted: Column, origin: Column) -> Column:
    """Whether a new query adds to a mention instead of naming another thing: one holds the other, or their letters nearly agree."""
    from tripleforge.operators.oie import locked

    a, b = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (wanted, origin))
    return (a == "") | (b == "") | F.contains(a, b) | F.contains(b, a) | locked(a, b)


def consistent_verdict(status: Column, feedback: Column, suggested: Column) -> Column:
    """Struct (status, suggested): an approval whose text speaks against it asks for another predicate."""
    doubts = F.lower(F.coalesce(feedback, F.lit(""))).rlike("|".join(CONTRADICTIONS)) & (status == "APPROVED")
    return F.struct(F.when(doubts, "ADJUST_PREDICATE").otherwise(status).alias("status"), F.when(doubts, "").otherwise(suggested).alias("suggested"))


def _label(tag: Column) -> Column:
    return F.substring(tag, 3, 1 << 20)


def chunks_valid(tags: Column) -> Column:
    """No I_ at the start, and no I_ with another label than the tag before it."""
    after = F.slice(tags, 2, F.greatest(F.size(tags) - 1, F.lit(0)))
    breaks = F.zip_with(F.slice(tags, 1, F.greatest(F.size(tags) - 1, F.lit(0))), after, lambda a, b: b.startswith("I_") & (a != "X") & (_label(a) != _label(b)))
    return (F.size(tags) == 0) | (~F.get(tags, F.lit(0)).startswith("I_") & ~F.exists(breaks, lambda x: x))


def resolved_tags(tags: Column) -> Column:
    """X tags continue the chunk before them; a first one begins the chunk after it (NP where that is an X too)."""

    def step(out: Column, x: Column) -> Column:
        second = F.get(tags, F.lit(1))
        first = F.when(second.isNull(), "NP").when(second == "X", "B_NP").otherwise(F.concat(F.lit("B_"), _label(second)))
        filled = F.when(x != "X", x).when(F.size(out) == 0, first).otherwise(F.concat(F.lit("I_"), _label(F.element_at(out, -1))))
        return F.array_append(out, filled)

    return F.aggregate(tags, F.array().cast("array<string>"), step)


def phrases(words: Column, tags: Column) -> Column:
    """(words, first) of each chunk: a B_ tag begins one, and words before the first one are left out."""

    def cut(rows: Column) -> Column:
        starts = F.filter(rows, lambda r: r["tag"].startswith("B_"))
        stop = lambda k: F.coalesce(F.get(starts, k + 1)["at"], F.size(rows))
        return F.transform(starts, lambda s, k: F.struct(F.transform(F.slice(rows, s["at"] + 1, stop(k) - s["at"]), lambda r: r["word"]).alias("words"), s["at"].alias("first")))

    rows = F.transform(F.arrays_zip(words.alias("word"), tags.alias("tag")), lambda r, i: F.struct(r["word"].alias("word"), r["tag"].alias("tag"), i.alias("at")))
    return _once(rows, cut)


def word_places(words: Column, phrase: Column) -> Column:
    """Struct (first, last): places of the first and last word of a phrase that occur, each by itself; a phrase only at place 0 counts as
    not found."""
    places = _once(words, lambda w: F.filter(F.transform(phrase, lambda p: F.array_position(w, p) - 1), lambda k: k >= 0))
    at = F.struct(F.get(places, F.lit(0)).alias("first"), F.element_at(places, -1).alias("last"))
    return F.when(F.size(places) == 0, F.lit(None)).when((F.get(places, F.lit(0)) == 0) & (F.element_at(places, -1) == 0), F.lit(None)).otherwise(at)


def nearest(words: Column, phrase: Column, others: Column) -> Column:
    """The one of ``others`` whose first place is nearest to the phrase's, the first of equal ones; null where none occurs."""

    def best(w: Column) -> Column:
        own = F.array_position(w, phrase)
        rows = F.filter(F.transform(others, lambda x, k: F.struct(F.abs(F.array_position(w, x) - own).alias("far"), k.alias("k"), x.alias("x"), F.array_position(w, x).alias("at"))), lambda r: r["at"] > 0)
        return F.when(own > 0, F.array_min(rows)["x"])

    return _once(words, best)


def antecedents(mentions: DataFrame, doc: str, place: str, pos: str, length: str) -> DataFrame:
    """(doc, place, antecedent) of the pronouns (PRON) that have one: the shortest proper noun (PROPN) before, else the nearest noun (NOUN)."""
    before = Window.partitionBy(doc).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    proper = F.min(F.when(F.col(pos) == "PROPN", F.struct(F.col(length).alias("n"), (-F.col(place)).alias("back")))).over(before)
    noun = F.max(F.when(F.col(pos) == "NOUN", F.col(place))).over(before)
    found = mentions.withColumns({"proper": proper, "noun": noun}).filter(F.col(pos) == "PRON")
    return found.select(doc, place, F.coalesce(-F.col("proper.back"), "noun").alias("antecedent")).filter("antecedent IS NOT NULL")


def bounded_windows(sizes: Column, limit: int) -> Column:
    """(first, last) of windows over sentences of so many pieces: as many whole sentences as fit, a longer one cut hard."""

    def windows(stops: Column) -> Column:
        total, steps = F.element_at(stops, -1), F.sequence(F.lit(1), F.size(stops) + F.floor(F.element_at(stops, -1) / limit).cast("int") + 1)

        def step(state: Column, _: Column) -> Column:
            first = state["first"]
            whole = F.array_max(F.filter(stops, lambda x: (x > first) & (x <= first + limit)))
            last = F.when(total <= first + limit, total).otherwise(F.coalesce(whole, first + limit))
            return F.when(first >= total, state).otherwise(F.struct(last.alias("first"), F.array_append(state["out"], F.struct(first.alias("first"), last.alias("last"))).alias("out")))

        start = F.struct(F.lit(0).cast("long").alias("first"), F.array().cast("array<struct<first:bigint,last:bigint>>").alias("out"))
        return F.aggregate(steps, start, step, lambda s: s["out"])

    stops = F.aggregate(sizes, F.array().cast("array<bigint>"), lambda out, n: F.array_append(out, F.coalesce(F.element_at(F.when(F.size(out) > 0, out), -1), F.lit(0)) + n))
    return _once(stops, lambda s: F.when(F.size(s) > 0, windows(s)).otherwise(F.array().cast("array<struct<first:bigint,last:bigint>>")))


def example_line(sub: Column, rel: Column, obj: Column) -> Column:
    """A triple as a prompt's example shows it."""
    name = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    value = F.when(obj.startswith('"'), F.regexp_replace(obj, '^"+|"+$', "")).otherwise(name(obj))
    return F.format_string('{"subject": "%s", "predicate": "%s", "object": "%s"}', name(sub), rel, value)

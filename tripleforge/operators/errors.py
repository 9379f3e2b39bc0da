"""Error classes of extractions, filters before a model judges them, and profiles of a benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleforge.functions.similarity import f1, safe_ratio

# Copulas that stand for no relation, English words that tell a mixed language, postpositions of a cut-off span.
COPULAS = ("है", "हैं", "था", "थे", "थी", "थीं", "hai", "hain", "tha", "the", "thi", "thin", "ho", "hoga", "hogi", "raha", "rahi", "रहा", "रही", "रहे", "होना", "हो")
ENGLISH_WORDS = ("is", "are", "was", "were", "has", "have", "had", "born", "in", "of", "from", "at", "to", "for", "located", "founded", "created", "built", "died")
POSTPOSITIONS = ("की", "के", "का", "को", "में", "से", "पर", "द्वारा")
GENERIC_RELATIONS = ("है", "थे", "property")
COPULA_RELATIONS = ("है", "थे", "हैं")
KINDS = ("correct", "missing_triple", "argument_span_error", "language_mixing", "predicate_placeholder", "predicate_normalization_failure")


def _bare(c: Column) -> Column:
    return F.replace(F.replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit("dbo:"), F.lit("")), F.lit("dbp:"), F.lit(""))


def _same(a: Column, b: Column) -> Column:
    return F.lower(F.trim(F.coalesce(a, F.lit("")))) == F.lower(F.trim(F.coalesce(b, F.lit(""))))


def error_class(pred: dict[str, Column], gold: dict[str, Column], aligned: Column) -> Column:
    """Class of one extraction (slots s, r, o): nothing extracted; else by the aligned predicate against gold's and the arguments; else
    by the raw predicate: English, a copula in it, or a relation that isn't gold's."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    effective = F.when(empty(aligned), pred["r"]).otherwise(aligned)
    raw = F.lower(F.trim(F.coalesce(pred["r"], F.lit(""))))
    letters = F.length(F.regexp_replace(raw, r"[^\p{L}]", ""))
    ascii_share = F.when(letters > 0, F.length(F.regexp_replace(raw, "[^a-z]", "")) / letters).otherwise(0.0)
    english = (letters > 0) & ((ascii_share > 0.65) | F.arrays_overlap(F.split(raw, r"\s+", -1), F.array(*[F.lit(w) for w in ENGLISH_WORDS])))
    copula = raw.rlike("|".join(COPULAS))
    arguments = _same(pred["s"], gold["s"]) & _same(pred["o"], gold["o"])
    return (
        F.when(empty(pred["s"]) & empty(pred["r"]) & empty(pred["o"]), "missing_triple")
        .when(_bare(effective) == _bare(gold["r"]), F.when(arguments, "correct").otherwise("argument_span_error"))
        .when(english, "language_mixing")
        .when(copula, "predicate_placeholder")
        .otherwise("predicate_normalization_failure")
    )


def slot_scores(rows: DataFrame) -> DataFrame:
    """Scores of rows (error_type, ps, pr, po, gs, gr, go, aligned): precision over what was extracted, recall over all, and the share of
    extractions whose slot is gold's."""
    out = F.col("error_type") != "missing_triple"
    n, extracted, correct = F.count(F.lit(1)), F.count_if(out), F.count_if(F.col("error_type") == "correct")
    p, r = safe_ratio(correct, extracted), safe_ratio(correct, n)
    effective = F.when(F.coalesce("aligned", F.lit("")) == "", F.col("pr")).otherwise(F.col("aligned"))
    share = lambda same: F.round(safe_ratio(F.count_if(out & same), extracted), 3)
    return rows.agg(
        n.alias("total"), extracted.alias("extracted"), correct.alias("correct"), F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), F.round(f1(p, r), 3).alias("f1"),
        share(_same(F.col("ps"), F.col("gs"))).alias("subject_accuracy"), share(_same(F.col("po"), F.col("go"))).alias("object_accuracy"), share(_bare(effective) == _bare(F.col("gr"))).alias("predicate_accuracy"),
    )


def _first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__k = 1").drop("__k")


def filtered(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Extractions (by, head, rel, tail) that are worth a judge: no span that ends in a postposition, no object in the relation, no
    generic relation; of equal ones the first."""
    cut_off = lambda c: F.col(c).rlike(" (?:" + "|".join(POSTPOSITIONS) + ")$")
    kept = rows.filter(~cut_off("head") & ~cut_off("tail") & ~F.col("rel").contains(" को") & ~F.trim("rel").isin(*GENERIC_RELATIONS))
    return _first(kept, [by, "head", "rel", "tail"], order)


def prepared(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Extractions made comparable: spans without a postposition at their end, copulas as ``property``. Empty slots, relations that hold
    a noun, and a head that is the tail go; of equal ones the first stays."""
    end = r"\s+(?:" + "|".join(POSTPOSITIONS) + ")$"
    clean = rows.withColumns({c: F.regexp_replace(F.trim(c), end, "") for c in ("head", "tail")} | {"rel": F.when(F.trim("rel").isin(*COPULA_RELATIONS), "property").otherwise(F.trim("rel"))})
    kept = clean.filter("head <> '' AND rel <> '' AND tail <> '' AND head <> tail").filter(~F.col("rel").rlike(" (?:को|का|की) "))
    return _first(kept, [by, "head", "rel", "tail"], order)


def augmented(rows: DataFrame, by: str) -> DataFrame:
    """Triples made of two extractions (by, head, rel, tail) of a sentence with the same relation and one argument in common: what only the
    one has, the relation with the common argument, what only the other has. Of each four words one is made, in the order of the words."""
    sides = rows.select(by, "rel", "head", "tail").distinct()
    arguments = lambda: sides.select(by, "rel", F.explode(F.array(F.struct(F.col("head").alias("own"), F.col("tail").alias("common")), F.struct(F.col("tail").alias("own"), F.col("head").alias("common")))).alias("x")).select(by, "rel", "x.own", "x.common").filter("own <> common AND own <> rel AND common <> rel").distinct()
    a, b = arguments(), arguments().withColumnRenamed("own", "other")
    return a.join(b, [by, "rel", "common"]).filter("own < other").select(by, F.col("own").alias("head"), F.concat_ws(" ", "rel", "common").alias("rel"), F.col("other").alias("tail"))


def benchmark_micro(gold: DataFrame, pred: DataFrame, by: list[str], triple: list[str]) -> DataFrame:
    """Micro scores: predictions of a sentence count once, gold lines each time; predictions for unknown sentences don't count."""
    sentences = gold.select(*by).distinct()
    once = pred.select(*by, *triple).distinct().join(sentences, by, "left_semi").withColumn("hit", F.lit(1))
    n_pred = once.agg(F.count(F.lit(1)).alias("n_predicted"))
    joined = gold.select(*by, *triple).join(once, [*by, *triple], "left").agg(F.count(F.lit(1)).alias("n_gold"), F.count("hit").alias("n_correct"))
    p, r = safe_ratio(F.col("n_correct"), F.col("n_predicted")), safe_ratio(F.col("n_correct"), F.col("n_gold"))
    n = sentences.agg(F.count(F.lit(1)).alias("n_sentences"))
    return joined.crossJoin(n_pred).crossJoin(n).select("n_sentences", "n_gold", "n_predicted", "n_correct", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1(p, r), 6).alias("f1"))


def dataset_profile(triples: DataFrame, by: str) -> DataFrame:
    """Sentences by their number of triples, literal objects (quoted) and changing subjects of triples (by, sub, obj), and the best
    scores of a system that gives one triple a sentence."""
    quoted = F.trim("obj").startswith('"')
    each = triples.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(quoted).alias("literals"), F.count_distinct("sub").alias("subjects"))
    total = F.sum("n")
    mean = total / F.count(F.lit(1))
    r = 1 / mean
    return each.agg(F.count(F.lit(1)).alias("sentences"), total.alias("triples"), F.round(mean, 6).alias("per_sentence"), F.round(100 * F.sum("literals") / total, 1).alias("literal_pct"), F.round(100 * F.count_if(F.col("subjects") > 1) / F.count(F.lit(1)), 1).alias("multi_subject_pct"), F.round(r, 6).alias("one_triple_recall"), F.round(2 * r / (1 + r), 6).alias("one_triple_f1"))


def value_formats(train: DataFrame) -> DataFrame:
    """(pid, unit, float0, date_style) that training values (pid, value) agree on.

    The unit in parentheses after a number where at least two values and four fifths of the parenthesised have it; float0 where two bare
    numbers end in ``.0`` and none is whole; English dates where there are as many of these as of ISO ones. Null where nothing is learned."""
    months = "(?:january|february|march|april|may|june|july|august|september|october|november|december)"
    value = F.trim(F.regexp_replace(F.trim("value"), '^"+|"+$', ""))
    rows = train.select("pid", value.alias("v")).withColumn("unit", F.trim(F.regexp_extract(F.replace("v", F.lit("_"), F.lit(" ")), r"^[\d.]+\s*\(([^)]+)\)$", 1)))
    plain = F.col("unit") == ""
    english = F.lower("v").rlike(rf"^(?:\d{{1,2}}\s+{months}\s+\d{{4}}|{months}\s+\d{{1,2}},?\s+\d{{4}}|{months},?\s+\d{{4}})$")
    count = lambda c: F.count_if(plain & c)
    shapes = rows.groupBy("pid").agg(count(F.col("v").rlike(r"^\d+\.0$")).alias("f"), count(F.col("v").rlike(r"^\d+$")).alias("i"), count(english).alias("e"), count(F.col("v").rlike(r"^\d{4}-\d{2}-\d{2}$")).alias("d"))
    units = rows.filter(~plain).groupBy("pid", "unit").agg(F.count(F.lit(1)).alias("n"))
    best = units.groupBy("pid").agg(F.max(F.struct("n", "unit")).alias("top"), F.sum("n").alias("all")).filter("top.n >= 2 AND top.n >= 0.8 * all").select("pid", F.col("top.unit").alias("unit"))
    style = F.when((F.col("e") > 0) | (F.col("d") > 0), F.when(F.col("e") >= F.col("d"), "english").otherwise("iso"))
    return shapes.join(best, "pid", "left").select("pid", "unit", ((F.col("f") >= 2) & (F.col("i") == 0)).alias("float0"), style.alias("date_style"))

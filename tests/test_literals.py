"""Literal forms, context variants and clustered gold patterns."""

from pyspark.sql import functions as F

from tripleforge.functions.literals import context_variants, literal
from tripleforge.operators.clusters import cluster_scores, matches, micro


def test_literals(spark):
    rows = [
        ("106,000", "populationTotal", "number", ("106000", False)), ("2,000 feet", "runwayLength", "number", ("2000.0", False)), ("927", "foundingYear", "year", ("0927", False)),
        ("01325", "areaCode", "string", ("01325", False)), ("January 1st, 1726", "birthDate", "date", ("1726-01-01", False)), ("December 2008", "completionDate", "", ("December 2008", True)),
        ("In God we trust", "motto", "string", ("In God we trust", True)), ('"President"', "title", "string", ("President", False)), ("14-03-2001", "date", "date", ("2001-03-14", False)), (None, None, None, ("", False)),
    ]
    got = spark.createDataFrame([(k, *r[:3]) for k, r in enumerate(rows)], "k int, raw string, p string, r string").select("k", literal(F.col("raw"), F.col("p"), F.col("r")).alias("x")).orderBy("k").collect()
    assert [tuple(g.x) for g in got] == [r[3] for r in rows]


def test_context_variants(spark):
    row = spark.createDataFrame([("Mermaid", "Train's hit Mermaid of 2012."), ("", "a film"), ("X", None)], "m string, s string").select(context_variants(F.col("m"), F.col("s")).alias("v")).collect()
    assert row[0].v == ["Mermaid (2012 song)", "Mermaid (Train song)", "Mermaid (song)"] and row[1].v == row[2].v == []


def test_patterns(spark):
    assert matches("the cat --> sat [down] on --> a mat", ("The cat", "sat on", "a mat"))
    assert matches("cat --> eaten by --> dog <--{allowed in passive}", ("dog", "eaten by", "cat"), passive=False)
    assert not matches("cat --> eats --> dog <--{not allowed in passive}", ("dog", "eats", "cat"))
    assert matches("a --> b --> c |OR| d --> e --> f", ("d", "e", "f"))
    gold = spark.createDataFrame([("1", "c1", "essential", "a --> b --> c"), ("1", "c1", "essential", "d --> e --> f"), ("1", "c2", "essential", "a --> b --> c"), ("1", "c2", "compensatory", "x --> y --> z"), ("2", "c1", "essential", "q --> r --> s")], "sent_id string, cluster string, kind string, pattern string")
    found = spark.createDataFrame([("1", "a", "b", "c"), ("1", "a", "b", "c"), ("1", "no", "no", "no")], "sent_id string, arg1 string, rel string, arg2 string")
    assert sorted(tuple(r) for r in cluster_scores(gold, found).collect()) == [("1", 1, 1, 0), ("2", 0, 0, 1)]
    assert tuple(micro(cluster_scores(gold, found)).first()) == (1, 1, 1, 0.5, 0.5, 0.5)


def test_learned_date_styles(spark):
    """Formats that are learned from training values, and what they make of raw ones."""
    from pyspark.sql import functions as F

    from tripleforge.functions.literals import literal
    from tripleforge.operators.errors import value_formats

    train = [("completionDate", "2009-06-01")] * 18 + [("completionDate", '"April 2014"')] + [("startDate", '"30 March 2007"')] * 3 + [("added", "1987-02-27")] * 2
    train += [("mass", '"6603633000.0 (kilometres)"')] * 4 + [("mass", "1.0 (miles)")] + [("len", "5.0")] * 2 + [("width", "5.0"), ("width", "5.0"), ("width", "7")] + [("one", "2.0 (kg)")]
    got = {r.pid: (r.unit, r.float0, r.date_style) for r in value_formats(spark.createDataFrame(train, "pid string, value string")).collect()}
    assert got == {"completionDate": (None, False, "iso"), "startDate": (None, False, "english"), "added": (None, False, "iso"), "mass": ("kilometres", False, None), "len": (None, True, None), "width": (None, False, None), "one": (None, False, None)}
    cases = [
        ("December 2008", "completionDate", "date", True, "iso", ("December 2008", True)),
        ("30 March 2007", "buildingStartDate", "date", True, "english", ("30 March 2007", True)),
        ("February 27th, 1987", "added", "", False, "iso", ("1987-02-27", False)),
        ("1988", "completionDate", "date", False, "english", ("1988", False)),
        ("31 July 2016 (JD2457600.5)", "epoch", "", False, "iso", ("31 July 2016 (JD2457600.5)", True)),
    ]
    rows = spark.createDataFrame([c[:5] for c in cases], "raw string, pid string, kind string, hint boolean, style string")
    made = [tuple(r.x) for r in rows.select(literal(F.col("raw"), F.col("pid"), F.col("kind"), F.col("hint"), F.col("style")).alias("x")).collect()]
    assert [m[0] for m in made] == [c[5][0] for c in cases] and made[0][1] and made[1][1] and not made[3][1]

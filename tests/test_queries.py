"""Every registered query against its SQL, and those without SQL against plain Python."""

import collections

import duckdb
import pytest

from tripleforge.plans import registry, tables

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_against_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[k]) for k in at) for r in found.fetchall())


def test_all_have_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and registry.FLAGSHIP in registry.queries()


def test_k_core(spark):
    got = {(r.s, r.p, r.o) for r in registry.queries()["graph_k_core"](spark, SF).collect()}
    edges = [(r.s, r.p, r.o) for r in tables.edges(spark, SF).collect()]
    often = collections.Counter(p for _, p, _ in edges)
    edges = [e for e in edges if often[e[1]] >= 50]
    while True:
        degree = collections.Counter(x for s, _, o in edges for x in (s, o))
        kept = [e for e in edges if degree[e[0]] >= 6 and degree[e[2]] >= 6]
        if len(kept) == len(edges):
            break
        edges = kept
    assert got == set(edges)


def test_mmr_picks(spark):
    picks = collections.defaultdict(list)
    for r in registry.queries()["mmr_examples"](spark, SF).collect():
        picks[r.qid].append((r.pick, r.id))
    assert picks and all([k for k, _ in sorted(v)] == list(range(1, len(v) + 1)) and len({i for _, i in v}) == len(v) <= 6 for v in picks.values())


def test_variants(spark):
    from pyspark.sql import functions as F

    from tripleforge.functions.text import surface_variants

    row = spark.createDataFrame([("The A.B-C_d!",), ("",), (None,)], "m string").select(surface_variants(F.col("m")).alias("v")).collect()
    assert row[0].v[0] == "the a.b-c_d!" and "a.b-c_d" in row[0].v and "the ab c_d" in row[0].v
    assert row[1].v == []


def test_clusters_and_alignment(spark):
    assert registry.queries()["vector_clusters"](spark, SF).count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert "<" not in "".join(r.body for r in registry.queries()["main_text"](spark, SF).collect())


def test_mmr_choice(spark):
    """The greedy choice against plain Python, from the same pool."""
    import re

    from tripleforge.operators import retrieval

    texts = ["red cat sat", "red cat", "blue dog ran", "red cat sat down", "green bird", "dog ran red"]
    items = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    pool = retrieval.bm25_search(items, spark.createDataFrame([(0, "red cat dog")], "qid long, text string")).join(items, "id")
    rows = sorted(((r.score, -r.id, r.id, r.text) for r in pool.collect()), reverse=True)
    words = {r[2]: set(re.findall("[a-z0-9]+", r[3])) for r in rows}
    chosen = []
    while len(chosen) < 3:
        value = lambda r: 0.5 * r[0] / rows[0][0] - 0.5 * max((len(words[r[2]] & words[c]) / len(words[r[2]] | words[c]) for c in chosen), default=0.0)  # noqa: B023, E731
        chosen.append(max((r for r in rows if r[2] not in chosen), key=lambda r: (value(r), r[0], r[1]))[2])
    got = {r.pick: r.id for r in retrieval.mmr(pool.select("qid", "id", "score", "text"), k=3).collect()}
    assert [got[k] for k in (1, 2, 3)] == chosen


def test_main_text_cases(spark):
    from pyspark.sql import functions as F

    from tripleforge.functions.text import main_text

    html = "<html><head><style>p { x }</style><script>var a = '<b>';</script></head><nav>menu</nav><body><p>One <b>two</b></p>\n<footer>end</footer><aside>ad</aside></body></html>"
    assert [r.t for r in spark.createDataFrame([(html,), ("plain",), ("",), (None,)], "h string").select(main_text(F.col("h")).alias("t")).collect()] == ["One two", "plain", "", None]


def test_clusters_best_of_three(spark):
    """k-means gives each row one of k clusters, each its nearest centre's."""
    rows = registry.queries()["vector_clusters"](spark, SF).collect()
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    import numpy as np

    k = len({r.cluster for r in rows})
    assert k in (4, 8, 12) and set(vectors) == {r.vec_id for r in rows}
    centres = {c: np.mean([vectors[r.vec_id] for r in rows if r.cluster == c], axis=0) for c in {r.cluster for r in rows}}
    near = sum(min(centres, key=lambda c: np.linalg.norm(np.array(vectors[r.vec_id]) - centres[c])) == r.cluster for r in rows)
    assert near > 0.9 * len(rows)


def test_gate(spark):
    """Each rung of the ladder: exact, inverted, symmetric, range asymmetry with and without ranges, any relation, missing object, missing subject,
    unknown."""
    from tripleforge.operators.graph import verify

    edges = spark.createDataFrame([("A", "p", "B"), ("C", "r", "D"), ("K", "type", "City"), ("L", "type", "Land"), ("C", "spouse", "D")], "s string, p string, o string")
    asked = {("A", "p", "B"): "VERIFIED", ("B", "p", "A"): "INVERTED", ("D", "spouse", "C"): "RELATED", ("A", "q", "B"): "RELATED", ("A", "p", "C"): "FAITHFUL", ("A", "p", "X"): "OBJ_MISSING", ("X", "p", "A"): "REJECTED", ("X", "p", "Y"): "REJECTED", ("A", "p", "I"): "UNVERIFIED", ("A", "p", "U"): "UNVERIFIED", ("K", "capital", "L"): "FAITHFUL", ("L", "capital", "K"): "FAITHFUL"}
    triples = spark.createDataFrame(list(asked), "s string, p string, o string")
    node = lambda *n: spark.createDataFrame([(x,) for x in n], "node string")
    got = {(r.s, r.p, r.o): r.status for r in verify(edges, triples, ("spouse",), node("I"), node("U")).collect()}
    assert got == asked
    ranges = spark.createDataFrame([("capital", "City")], "p string, range string")
    got = {(r.s, r.p, r.o): r.status for r in verify(edges, triples, ("spouse",), node("I"), node("U"), ranges, "type").collect()}
    assert got == {**asked, ("K", "capital", "L"): "INVERTED"}


def test_redirects(spark):
    from tripleforge.operators.index import redirect_closure
    from tripleforge.plans.checkpoints import ensure

    ensure(spark)
    rows = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("t", "x"), ("s", "s")] + [(f"n{k}", f"n{k + 1}") for k in range(12)]
    got = {r.src: r.dst for r in redirect_closure(spark.createDataFrame(rows, "src string, dst string")).collect()}
    assert (got["a"], got["b"], got["x"], got["y"], got["t"]) == ("c", "c", "x", "y", "x") and "s" not in got
    assert (got["n0"], got["n1"], got["n2"], got["n11"]) == ("n10", "n11", "n12", "n12")


def test_redirects_several(spark):
    """A page with several redirects has one row: the end of its longest way, the largest of equally long ones."""
    from tripleforge.operators.index import redirect_closure
    from tripleforge.plans.checkpoints import ensure

    ensure(spark)
    rows = [("a", "z"), ("a", "b"), ("b", "c"), ("b", "d"), ("b", "d"), ("s", "s"), ("s", "a"), ("x", "y"), ("y", "x"), ("x", "b")]
    got = sorted(tuple(r) for r in redirect_closure(spark.createDataFrame(rows, "src string, dst string")).collect())
    assert got == [("a", "d"), ("b", "d"), ("s", "d"), ("x", "x"), ("y", "d")]


def test_top_k_blocks(spark, monkeypatch):
    from tripleforge.operators import vectors

    monkeypatch.setattr(vectors, "ROW_BLOCK", 70)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    queries = rows.filter("vec_id < 10").selectExpr("vec_id AS query_id", "embedding")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.sim) for r in vectors.top_k(rows, queries, 7).collect())
    monkeypatch.undo()
    assert got == sorted((r.query_id, r["rank"], r.vec_id, r.sim) for r in vectors.top_k(rows, queries, 7).collect()) and len(got) == 70


def test_ranks(spark):
    from pyspark.sql import functions as F

    from tripleforge.operators.ranks import global_rank, smallest

    rows = spark.createDataFrame([(k, (k * 7) % 5, None if k % 9 == 0 else f"t{k % 3}") for k in range(60)], "id long, a long, t string")
    got = {r.id: r["rank"] for r in global_rank(rows, {"t": F.col("t"), "a": F.col("a")}, [F.col("id")]).collect()}
    order = sorted(rows.collect(), key=lambda r: (r.t is not None, r.t or "", r.a, r.id))
    assert got == {r.id: k + 1 for k, r in enumerate(order)}
    digest = F.md5(F.col("id").cast("string").cast("binary"))
    import hashlib

    for n in (0, 1, 17, 60, 99):
        want = sorted(range(60), key=lambda k: (hashlib.md5(str(k).encode()).hexdigest(), k))[:n]
        assert sorted(r.id for r in smallest(rows, n, digest, "id").collect()) == sorted(want)


def test_tables_of_mentions(spark, tmp_path):
    from tripleforge.sources import dumps

    (tmp_path / "m.csv").write_text('mention,context\n"a ""b""",x\n')
    (tmp_path / "m.jsonl").write_text('{"mention": "c"}\n')
    (tmp_path / "labels_en.ttl.bz2").write_text("")
    assert dumps.mention_table(spark, str(tmp_path / "m.csv")).collect() == [('a "b"', "x")]
    assert dumps.mention_table(spark, str(tmp_path / "m.jsonl")).collect() == [("c", None)]
    with pytest.raises(ValueError):
        dumps.mention_table(spark, str(tmp_path / "m.xls"))
    assert dumps.find_dump(str(tmp_path), "labels").endswith("labels_en.ttl.bz2")
    with pytest.raises(FileNotFoundError):
        dumps.find_dump(str(tmp_path), "redirects")

"""Operators on small tables, and every query that has SQL against DuckDB."""

import os

import duckdb
import pytest

from termlake.operators import claims, documents, graph, resolution
from termlake.plans import core, flows, library
from termlake.sources import quads

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(core.oracle_sql() | flows.oracle_sql() | library.oracle_sql()))
def test_query(spark, duck, name):
    shown = lambda rows: sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows)
    ours = (core.queries() | flows.queries() | library.queries())[name](spark, SF)
    theirs = duck.execute((core.oracle_sql() | flows.oracle_sql() | library.oracle_sql())[name])
    columns = [x[0] for x in theirs.description]
    assert sorted(columns) == sorted(ours.columns)
    assert shown(map(tuple, ours.select(*columns).collect())) == shown(theirs.fetchall())


def test_cycle_and_expansion(spark):
    broader = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "child string, parent string")
    assert {r["node"] for r in graph.cycles(broader).collect()} == {"a", "b", "c"}
    steps = spark.createDataFrame([("x", "y"), ("y", "z")], "seed string, neighbour string")
    seeds = spark.createDataFrame([("x",)], "seed string")
    assert {r["node"] for r in graph.expand(seeds, steps, 2).collect()} == {"x", "y", "z"}
    assert {r["node"] for r in graph.expand(seeds, steps, 0).collect()} == {"x"}


def test_gate(spark):
    concepts = spark.createDataFrame([("a", "s", "d", True), ("b", "s", None, False), ("c", "s", "d", False)], "concept_id string, scheme_id string, definition string, is_top boolean")
    labels = spark.createDataFrame([("a", "s", "Gas", "en", "pref"), ("b", "s", "gas", "en", "pref"), ("b", "s", "gas", "en", "alt")], "concept_id string, scheme_id string, label string, language string, kind string")
    broader = spark.createDataFrame([("b", "zz")], "child string, parent string")
    found = {(r["concept_id"], r["message"]) for r in graph.gate(concepts, labels, broader).collect()}
    assert ("c", "has no preferred label") in found
    assert ("a", "shares a label with another concept of its scheme") in found
    assert ("b", "has a parent that does not exist") in found
    assert ("b", "has a label that is both preferred and alternative") in found
    assert ("c", "has no parent and is not on top") in found


def test_contradictions_need_one_dimension(spark):
    rows = [("k", 1.0, "flow", False), ("k", 2.0, "flow", False), ("m", 1.0, "flow", False), ("m", 2.0, "volume", False), ("n", 1.0, None, False), ("n", 1.001, None, False), ("o", 1.0, "flow", False), ("o", 9.0, "flow", True)]
    sides = spark.createDataFrame(rows, "k string, value double, dimension string, approximate boolean")
    assert {r["k"] for r in claims.contradictions(sides, ["k"]).collect()} == {"k", "n"}


def test_corrections(spark):
    pairs = spark.createDataFrame([("filtre", "filter"), ("gas", "gas"), ("x", ""), ("two words", "two totally"), ("ab", "ac"), ("ab", "ad")], "original string, corrected string")
    assert [(r["original"], r["corrected"]) for r in resolution.correction_map(pairs).collect()] == [("filtre", "filter")]


def test_chunks(spark):
    many = "\n".join(["w " * 100] * 7)  # 300 words fill a chunk of 400 tokens
    docs = spark.createDataFrame([(1, "\n# A\none two\n\n# B\nthree\n"), (2, None), (3, "  \n\t\n"), (4, many), (5, "x\r\n" + many)], "doc_id bigint, text string")
    found = documents.chunks(docs).orderBy("doc_id", "chunk_no").collect()
    assert [(r["start_line"], r["end_line"], r["heading"], r["text"]) for r in found if r["doc_id"] == 1] == [(2, 4, "A", "# A\none two"), (5, 6, "B", "# B\nthree")]
    assert not [r for r in found if r["doc_id"] in (2, 3)]
    assert [(r["start_line"], r["end_line"]) for r in found if r["doc_id"] == 4] == [(1, 3), (4, 6), (7, 7)]
    assert [(r["start_line"], r["end_line"], r["heading"]) for r in found if r["doc_id"] == 5] == [(1, 4, None), (5, 7, None), (8, 8, None)]
    page = documents.source_lines(spark.createDataFrame([(1, "<!-- x\ny --><h1>A</h1>\n\n<p>b</p>", True)], "doc_id bigint, text string, is_html boolean"))
    assert [(r["start_line"], r["end_line"], r["text"]) for r in documents.chunk_lines(page).collect()] == [(2, 4, "A\nb")]


def test_overlap_join(spark):
    a = [(k, s, s + n) for k in "xy" for s, n in ((1, 0), (5, 200), (60, 10), (64, 0), (300, -1))]
    b = [(k, s, s + n) for k in "xz" for s, n in ((1, 4), (63, 2), (100, 100), (129, 0))]
    found = documents.overlap_join(spark.createDataFrame(a, "k string, a_start int, a_end int"), spark.createDataFrame(b, "k string, b_start int, b_end int"), "k")
    want = [(*x, *y[1:]) for x in a for y in b if x[0] == y[0] and x[1] <= x[2] and x[1] <= y[2] and x[2] >= y[1]]
    assert sorted(tuple(r) for r in found.select("k", "a_start", "a_end", "b_start", "b_end").collect()) == sorted(want)


def test_quads(spark, tmp_path):
    (tmp_path / "q.nq").write_text('<a> <p> "x"@en <g> .\n# no\n<a> <q> <b> <g> .\n<a> <q> <b> <g> .\n')
    read = quads.read_nquads(spark, str(tmp_path / "q.nq"))
    assert read.count() == 3 and read.where("lang = 'en'").count() == 1
    assert quads.digest(read) == quads.digest(read.dropDuplicates())
    assert quads.publish(read, f"file://{tmp_path}/v", 0) == 1
    with pytest.raises(quads.VersionConflict):
        quads.publish(read, f"file://{tmp_path}/v", 0)

"""Asking, run records, places in texts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termlake.functions import text as T
from termlake.operators import asking, documents, runs, similarity, vector_index
from termlake.plans import core, flows


@pytest.fixture
def answer(spark):
    questions = spark.createDataFrame([("q1", "how often do I replace the gas bottle limescale?"), ("q2", "what is a frobnicator"), ("q3", "the odd process")], "id string, text string")
    index = spark.createDataFrame([("gas bottle", ["bottle"]), ("gas", ["gas"]), ("odd", ["odd"]), ("two", ["a", "b"])], "label_key string, concepts array<string>")
    steps = spark.createDataFrame([("bottle", "valve")], "seed string, neighbour string")
    passages = spark.createDataFrame([(1, "bottle", 1.0), (2, "valve", 2.0), (3, "gas", 9.0)], "passage_id bigint, concept_id string, weight double")
    claims = spark.createDataFrame([("c1", "bottle", "interval", "6"), ("c2", "valve", "interval", "4"), ("c3", "gas", "x", "y")], "claim_id string, concept_id string, predicate string, value string")
    conflicts = spark.createDataFrame([("c1", "c2"), ("c2", "c1"), ("c1", "c2")], "claim_id string, conflicts_with string")
    return asking.retrieve(questions, index, steps, passages, asking.claims_with_conflicts(claims, conflicts))


def test_answer(answer):
    assert {(r["id"], r["concept_id"]) for r in answer.resolved.collect()} == {("q1", "bottle"), ("q3", "odd")}
    assert {(r["id"], r["term"]) for r in answer.unresolved.collect()} == {("q1", "limescale"), ("q2", "frobnicator")}
    assert [(r["id"], r["rank"], r["passage_id"]) for r in answer.passages.orderBy("id", "rank").collect()] == [("q1", 1, 2), ("q1", 2, 1)]
    assert [(r["id"], r["sides"]) for r in answer.disagreements.collect()] == [("q1", 2)]


def test_events(answer):
    rows = asking.events(answer).orderBy("id", "seq").collect()
    assert [r["type"] for r in rows if r["id"] == "q1"] == ["concept", "concept", "conflict", "text_delta", "done"]
    assert [r["origin"] for r in rows if r["id"] == "q2"] == ["miss", "answer", "answer"]
    said = {r["id"]: r["item"] for r in rows if r["type"] == "text_delta"}
    assert said["q2"].startswith("I don't have anything on “frobnicator”")
    assert said["q3"] == asking.NOTHING_FOUND
    assert "FACTS:\n- bottle interval 6" in said["q1"]


def test_places(spark):
    rows = [("ab cd\nef  gh", "cd ef gh"), ("a.b axb", "axb"), ("x", "y"), ("x", " "), ("x", None), ("a\\Eb  c", "a\\Eb c")]
    df = spark.createDataFrame(rows, "text string, snippet string")
    found = [r["at"] and tuple(r["at"]) for r in df.select(documents.locate(F.col("snippet"), F.col("text")).alias("at")).collect()]
    assert found == [(3, 12), (4, 7), None, None, None, (0, 7)]
    assert df.select(documents.line_of(F.lit(7), F.col("text")).alias("n")).first()["n"] == 2


def test_all_snippets_of_a_document(spark):
    """As locate() and line_of() find them one by one, for any white space, overlaps and repeated documents."""
    rnd = random.Random(2)
    texts = ["".join(rnd.choices(["a", "b", "ab", " ", "  ", "\n", "\t", "é"], k=rnd.randrange(80))) for _ in range(25)] + [None, "", "\n\n"]
    wanted = [(i % len(texts), "".join(rnd.choices(["a", "b", " ", "\n", "ab", "é"], k=rnd.randrange(6)))) for i in range(900)] + [(0, None), (None, "a"), (99, "a")]
    docs = spark.createDataFrame([(i, text, None) for i, text in enumerate(texts)] + [(3, texts[3], None)], "doc_id bigint, text string, numbers array<int>")
    asked = spark.createDataFrame(wanted, "doc_id bigint, snippet string")
    at = documents.locate(F.col("snippet"), F.col("text"))
    one = asked.distinct().join(docs.dropDuplicates(["doc_id"]), "doc_id").withColumn("at", at).where("at is not null")
    line = lambda offset: documents.line_of(offset, F.col("text"))
    one = one.select("doc_id", "snippet", "at.start", "at.end", line(F.col("at.start")), line(F.greatest(F.col("at.end") - 1, F.col("at.start"))))
    found = documents.locate_all(asked, docs)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, one.collect())) and found.count() > 100
    numbered = spark.createDataFrame([(1, "x y\nz", [5, 9])], "doc_id bigint, text string, numbers array<int>")
    assert tuple(documents.locate_all(spark.createDataFrame([(1, "y  z")], "doc_id bigint, snippet string"), numbered).first()) == (1, "y  z", 2, 5, 5, 9)


def test_html_lines(spark):
    df = spark.createDataFrame([(1, "<!-- a\nb --><p>one</p>\n\n<b>t</b>wo <!-- c -->"), (2, None)], "doc_id bigint, markup string")
    assert df.select(T.blank_comments(F.col("markup")).alias("x")).first()["x"] == "\n<p>one</p>\n\n<b>t</b>wo "
    assert [tuple(r) for r in documents.html_lines(df).collect()] == [(1, 2, 0, "one"), (1, 4, 4, "two")]


def test_runs(spark, tmp_path):
    log = runs.RunLog(spark, f"file://{tmp_path}/log")
    assert log.latest("publish") is None
    tries = []

    def shaky(event):
        tries.append(event)
        if len(tries) < 3:
            raise ValueError("not yet")
        return {"claims": 2}

    assert runs.run_steps(log, "r1", "publish", [("index", lambda e: {"claims": 1}), ("restate", shaky)], {"v": 1}, wait=0) == {"claims": 3}
    done = log.latest("publish")
    assert (done["status"], done["note"], [s["sk"] for s in done["steps"]]) == ("done", "3 claims", ["STEP#01#index", "STEP#02#restate"])
    assert [tuple(r) for r in runs.totals(log.rows()).collect()] == [("r1", "claims", 3)]

    def broken(event):
        raise ValueError("no")

    with pytest.raises(ValueError):
        runs.run_steps(log, "r2", "publish", [("index", broken), ("never", shaky)], {}, wait=0)
    failed = log.run("r2")
    assert failed["status"] == "failed" and [s["status"] for s in failed["steps"]] == ["failed"]
    assert [r["run_id"] for r in log.runs().collect()] == ["r2", "r1"]
    log.write_audit("c", log.clock(), "r1", 1, "me", None, "history/c/1", "d")
    assert log.audit().count() == 1


def test_pages_decode_what_their_sql_decodes(spark, tmp_path):
    """Entities that lost their semicolon or are in no list stay, in the whole page and in its lines."""
    duckdb = pytest.importorskip("duckdb")
    pages = ["<p>R&amp{D &ampp x</p>", "a &amp;lt; b &quo c\n<b>&eacute;&copy;&nbsp;d</b> &#39;&#38;", "&am", "<!-- &amp; --> &middot"]
    spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for query, said in ((core.flatten_pages, core.oracle_sql()["flatten_pages"]), (flows.html_lines, flows.oracle_sql()["html_lines"])):
        assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == sorted(sql.execute(said).fetchall())


def test_only_what_is_asked_for_is_computed(spark):
    """Who wants what a question resolved to waits for no search of passages and no claims."""
    made = []
    questions = spark.createDataFrame([("q1", "gas bottle")], "id string, text string")
    index = spark.createDataFrame([("gas", ["gas"])], "label_key string, concepts array<string>")
    steps = spark.createDataFrame([], "seed string, neighbour string")
    claims = spark.createDataFrame([("c1", "gas", "x", "y", ["c2"]), ("c2", "gas", "x", "z", ["c1"])], "claim_id string, concept_id string, predicate string, value string, conflicts array<string>")
    found = spark.createDataFrame([("q1", 1, 7, 0.25)], "query_id string, rank int, key bigint, distance double")
    a = asking.retrieve(questions, index, steps, None, lambda: made.append("claims") or claims, embed=lambda x: F.array(F.lit(1.0)), search=lambda *_: made.append("search") or found)
    assert [r["concept_id"] for r in a.searched.collect()] == ["gas"] and made == []
    assert [tuple(r) for r in a.passages.collect()] == [("q1", 1, 7, 0.75)] and made == ["search"]
    assert [r["sides"] for r in a.disagreements.collect()] == [2] and made == ["search", "claims"]


def test_all_cells_are_met_as_one(spark, tmp_path):
    """With all cells probed a search is exact, and a question meets each part of a concept's postings once, however many cells there are."""
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.normal(size=4).round(1).tolist(), ["a", "b"][: 1 + i % 2]) for i in range(400)]
    index = vector_index.VectorIndex.build(spark.createDataFrame(rows, "key bigint, vector array<double>, concepts array<string>"), f"file://{tmp_path}/index")
    asked = [(f"q{i}", rnd.normal(size=4).round(1).tolist()) for i in range(30)]
    wanted = [(q, c) for i, (q, _) in enumerate(asked) for c in "ab"[i % 2 :]]
    found = index.search(spark.createDataFrame(asked, "query_id string, vector array<double>"), spark.createDataFrame(wanted, "query_id string, concept string"), 3)
    best = []
    for q, v in asked:
        see = {c for x, c in wanted if x == q}
        near = sorted((round(1 - round(float(np.dot(v, w)), 6), 6), key) for key, w, own in rows if see & set(own))
        best += [(q, n, key, distance) for n, (distance, key) in enumerate(near[:3], 1)]
    assert sorted(map(tuple, found.collect())) == sorted(best)
    assert len(index.centres) == 20


def test_best_of_groups_and_of_items():
    """As if all products were rounded first and sorted: ties, few items, several items of a group."""
    rnd = np.random.default_rng(5)
    for n, groups, k in ((1, 1, 3), (4, 2, 5), (60, 9, 3), (60, 60, 5)):
        items = [(f"i{i:03}", f"g{rnd.integers(groups)}", rnd.integers(-2, 3, 3).astype(float).tolist()) for i in range(n)]
        queries = [(i, (rnd.integers(-2, 3, 3) / 30000).tolist()) for i in range(25)]
        a = pa.table([pa.array(x) for x in zip(*queries, strict=True)], names=["q", "a"])
        b = pa.table([pa.array(x) for x in zip(*items, strict=True)], names=["label", "g", "b"])
        for group in (None, "g"):
            out = similarity.best_of("q", "a", "b", ["label", "g"], ["label"], group, k, 4)(a, b).to_pylist()
            for q, v in queries:
                scored = sorted((-float(similarity.rounded(np.array([np.dot(v, w)]), 4)[0]), label, g) for label, g, w in items)
                want, seen = [], set()
                for score, label, g in scored:
                    if group is None or g not in seen:
                        want.append((label, g, -score))
                        seen.add(g)
                assert [(x["label"], x["g"], x["score"]) for x in out if x["q"] == q] == want[:k]

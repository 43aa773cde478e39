"""Steps whose work must grow no faster than their input: what they meet once, and what they must not carry along."""

import random

from pyspark.sql import functions as F

from termlake.functions import text as T
from termlake.llm import near_dedup
from termlake.operators import documents, resolution
from termlake.plans import core


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_snippets_are_found_without_a_group_for_each_document(spark):
    docs = [(i, f"a{i}  b\n\n c{i}\nlast", None) for i in range(50)] + [(7, "zz", None), (None, "a", None), (60, None, None)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, numbers array<int>")
    asked = spark.createDataFrame([(i, x) for i in range(61) for x in (f"b c{i}", "last", "nowhere", "b c", f"a{i} b", "b  c")] * 2 + [(None, "a"), (1, None)], "doc_id bigint, snippet string")
    found = documents.locate_all(asked, docs)
    assert "CoGroup" not in plan(found)
    rows = [tuple(r) for r in found.where("doc_id = 12").orderBy("snippet").collect()]
    assert rows == [(12, "a12 b", 0, 6, 1, 1), (12, "b  c", 5, 10, 1, 3), (12, "b c", 5, 10, 1, 3), (12, "b c12", 5, 12, 1, 3), (12, "last", 13, 17, 4, 4)]
    assert found.count() == 250


def test_chunks_carry_no_document_along(spark):
    text = "\n".join(f"# h{i}\nw" for i in range(3000))
    found = documents.chunks(spark.createDataFrame([(1, text), (2, "\x1c\n x\u3000y \u2003")], "doc_id bigint, text string"))
    assert "Generate" not in plan(found) and "aggregate(" not in plan(found)
    rows = found.orderBy("doc_id", "chunk_no").collect()
    assert [(r["chunk_no"], r["start_line"], r["end_line"], r["heading"], r["text"]) for r in rows if r["doc_id"] == 1] == [(i, 2 * i + 1, 2 * i + 2, f"h{i}", f"# h{i}\nw") for i in range(3000)]
    assert tuple(rows[-1]) == (2, 0, 1, 2, None, "x\u3000y")


def test_each_surface_is_resolved_once(spark):
    labels = spark.createDataFrame([("c1", "s", "Filter", "pref"), ("c2", "s", "Pump", "pref"), ("c3", "s", "pump!", "alt")], "concept_id string, scheme_id string, label string, kind string")
    mentions = spark.createDataFrame([(1, "filter"), (2, "FILTER"), (3, "filter"), (4, None), (4, None), (5, "pump"), (6, "…")], "id bigint, surface string")
    found = resolution.resolve(mentions, resolution.label_index(labels))
    assert "Aggregate [surface" in plan(found)
    assert found.columns[:3] == ["id", "surface", "normalised"]
    got = sorted((r["id"], r["surface"], r["normalised"], r["concept_id"], tuple(r["collision"])) for r in found.where("surface is not null").collect())
    assert got == [(1, "filter", "filter", "c1", ()), (2, "FILTER", "filter", "c1", ()), (3, "filter", "filter", "c1", ()), (5, "pump", "pump", None, ("c2", "c3")), (6, "…", "", None, ())]
    assert [(r["id"], r["normalised"], r["stage"]) for r in found.where("surface is null").collect()] == [(4, "", "abstain")] * 2


def test_only_pieces_of_several_bytes_are_folded(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choices(["a", "B", "7", " ", "\n", "-", "é", "ß", "ﬁ", "½", "e\u0301", "Ω", "İ", "—", "𝐀", "s"], k=rnd.randrange(30))) for _ in range(300)] + ["", "\u0301 a"]
    found = spark.createDataFrame([(x,) for x in texts], "text string").select("text", T.normalise(F.col("text")).alias("n"), T.merge_key(F.col("text")).alias("m"))
    found = found.select("*", T.singular(F.col("n")).alias("s"))
    assert "split(text" in plan(found.select("n"))
    for r in found.collect():
        assert r["n"] == " ".join("".join(map(T._folded, r["text"])).split()) and r["s"] == r["m"], r


def test_words_of_a_document_once(spark, tmp_path):
    spark.createDataFrame([(1, "b a b"), (1, "a"), (2, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, core.document_words(spark, str(tmp_path), once=True).collect())) == [(1, "a"), (1, "a"), (1, "b")]


def test_sets_of_other_pairs_are_not_shuffled(spark, monkeypatch):
    plans, stored = {}, near_dedup.stage_table
    monkeypatch.setattr(near_dedup, "stage_table", lambda df, name, *a, **k: plans.setdefault(name, []).append(plan(df)) or stored(df, name, *a, **k))
    base = " ".join(f"w{i}" for i in range(200))
    docs = [(1, base), (2, base + " end"), (3, "other words that nobody else has at all"), (4, base)]
    found = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert {r["doc_id"]: r["class_id"] for r in found.collect()} == {1: 1, 2: 1, 3: 3, 4: 1}
    assert plans["near-links"] and all(p.count("LeftSemi") >= 2 for p in plans["near-links"])
    assert "rank" not in plans["near-centers"][0]


def test_sets_stay_in_their_buckets(spark, monkeypatch):
    """No set of shingles is shuffled to the pairs of its node, and no band is before it is known that others have it."""
    plans, stored = {}, near_dedup.stage_table
    monkeypatch.setattr(near_dedup, "stage_table", lambda df, name, *a, **k: plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString()) or stored(df, name, *a, **k))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        words = [f"w{i}" for i in range(200)]
        docs = [(10 * g + i, " ".join([f"g{g}", *words[g * 40 : g * 40 + 40], *["odd"][:i], f"i{i % 2}"])) for g in range(5) for i in range(3)]
        found = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"))
        assert {r["doc_id"]: r["class_id"] for r in found.collect()} == {i: i // 10 * 10 for i, _ in docs}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    for plan_ in plans["near-links"]:
        scans = [x for x in plan_.splitlines() if "FileScan" in x and "keys" in x]
        assert scans and all("Bucketed: true" in x for x in scans)
    assert "near-bands" not in plans and all("bitmap" in x for x in plans["near-shared"])

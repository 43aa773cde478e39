"""Turtle in, a draft published, refused, replayed."""

import hashlib

import pytest
from pyspark.sql import functions as F

from termlake.operators import publishing as P
from termlake.operators.runs import RunLog
from termlake.sources import quads, turtle

TTL = """@prefix skos: <http://www.w3.org/2004/02/skos/core#> .
PREFIX ex: <http://example.org/>
# a comment
ex:s a skos:ConceptScheme .
ex:bottle a skos:Concept ; skos:inScheme ex:s ; skos:topConceptOf ex:s ;
  skos:prefLabel "gas bottle"@en , "Gasflasche"@de ; skos:definition \"\"\"holds "gas" too\"\"\"@en ; .
ex:valve a skos:Concept ; skos:inScheme ex:s ; skos:broader ex:bottle ; skos:prefLabel 'valve'@en ; skos:definition "d"@en ; ex:n 3, 2.5, true ; ex:b [ ex:p "x" ] .
"""


def test_turtle(spark):
    rows = {tuple(r)[:3] for r in turtle.read_turtle(spark, {"a.ttl": TTL}, "published").collect()}
    assert len(rows) == 17
    bottle, skos = "<http://example.org/bottle>", "<http://www.w3.org/2004/02/skos/core#"
    assert (bottle, f"{skos}prefLabel>", '"Gasflasche"@de') in rows
    assert (bottle, f"{skos}definition>", '"holds \\"gas\\" too"@en') in rows
    assert any(o == '"2.5"^^<http://www.w3.org/2001/XMLSchema#decimal>' for _, _, o in rows)
    with pytest.raises(turtle.TurtleError, match="b.ttl, line 2"):
        turtle.read_turtle(spark, {"a.ttl": TTL, "b.ttl": "\nnope:x a nope:y ."}, "published")


def test_publish(spark, tmp_path, monkeypatch):
    path, log = f"file://{tmp_path}/v", RunLog(spark, f"file://{tmp_path}/log")
    assert P.current_version(spark, path) == 0
    quads.publish(turtle.read_turtle(spark, {"a.ttl": TTL}, "published"), path, 0)
    draft = P.Draft("http://example.org/valve", alt=["tap"], pref="valve")
    done = P.publish(log, path, draft, "me")
    assert (done["version"], done["concept_version"]) == (2, 1)
    now = P.read_version(spark, path, 2)
    assert now.where("graph like 'history/%'").count() == 0  # nothing was published before
    assert now.where("predicate like '%contributor>' and object = '\"me\"'").count() == 1
    assert {(r["label"], r["kind"]) for r in P.views(now).labels.where("concept_id like '%valve'").collect()} == {("valve", "pref"), ("tap", "alt")}
    with pytest.raises(P.Refused) as refused:
        P.publish(log, path, P.Draft("http://example.org/valve", pref="Gas-Bottle"), "me")
    assert {m for _, m in refused.value.findings} == {"shares a label with another concept of its scheme"}
    with pytest.raises(P.Refused) as refused:
        P.publish(log, path, P.Draft("http://example.org/valve", related=["http://example.org/none"], scheme="http://example.org/other"), "me")
    assert {m for _, m in refused.value.findings} == {"has a related term that does not exist", "is in a scheme that does not exist"}
    assert P.current_version(spark, path) == 2
    real, raced = quads.publish, []

    def late(table, where, expected):
        if not raced:
            raced.append(real(P.apply(P.read_version(spark, where, expected), P.Draft("http://example.org/bottle", hidden=["botle"]), 1), where, expected))
        return real(table, where, expected)

    monkeypatch.setattr(quads, "publish", late)
    done = P.publish(log, path, P.Draft("http://example.org/valve", alt=["cock"]), "me", "note")
    assert (done["version"], done["concept_version"]) == (4, 2)
    labels = {r["label"] for r in P.views(P.read_version(spark, path, 4)).labels.collect()}
    then = P.read_version(spark, path, 4)
    assert [r["object"] for r in then.where("predicate like '%wasRevisionOf>' and subject like '%valve>'").collect()] == ["<history/http://example.org/valve/1>"]
    assert {r["object"] for r in then.where("graph = 'history/http://example.org/valve/1' and predicate like '%altLabel>'").collect()} == {'"tap"@en'}
    assert quads.digest(then) == quads.digest(then.repartition(3)) != quads.digest(now)
    assert labels == {"gas bottle", "Gasflasche", "botle", "valve", "cock"}
    assert [r["version"] for r in log.audit().orderBy("version").collect()] == [1, 2]


def test_a_writer_that_dies_blocks_no_one(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/v"
    table = turtle.read_turtle(spark, {"a.ttl": TTL}, "published")
    table.write.parquet(f"{path}/data/left-behind")  # data without a pointer, as a writer leaves that dies between the two
    assert quads.current_version(spark, path) == 0
    assert quads.publish(table, path, 0) == 1
    late = []

    def slow(*args):
        """Another writer is first while this one writes its data."""
        if not late:
            late.append(True)
            monkeypatch.setattr(quads, "current_version", real)
            quads.publish(table.limit(1), path, 1)
        return 1

    real = quads.current_version
    monkeypatch.setattr(quads, "current_version", slow)
    with pytest.raises(quads.VersionConflict):
        quads.publish(table, path, 1)
    assert quads.current_version(spark, path) == 2
    assert P.read_version(spark, path, 2).count() == 1


def test_digest_is_that_of_the_dump(spark, tmp_path):
    table = turtle.read_turtle(spark, {"a.ttl": TTL}, "published")
    quads.write_nquads(table.union(table), f"file://{tmp_path}/dump")
    body = b"".join(p.read_bytes() for p in sorted((tmp_path / "dump").glob("part-*")))
    assert quads.digest(table) == hashlib.sha256(body).hexdigest()
    assert quads.digest(table.limit(0)) == hashlib.sha256(b"").hexdigest()
    assert quads.read_nquads(spark, f"file://{tmp_path}/dump").count() == table.count()
    assert quads.read_nquads(spark, f"file://{tmp_path}/nowhere").count() == 0


def test_seed_cache_and_binding(spark):
    table = turtle.read_turtle(spark, {"a.ttl": TTL}, "published")
    facts = table.limit(2).selectExpr("subject", "predicate", "object", "'facts' as graph", "lang", "datatype")
    with pytest.raises(quads.SeedRefused):
        quads.seed(table.union(facts), table.limit(1))
    assert quads.seed(table.union(facts), table.limit(1), force=True).count() == 3
    assert quads.seed(table, table.limit(1)).count() == 1
    now, loads = [0.0], []
    cached = quads.Cached(lambda: loads.append(1) or table, 30, lambda: now[0])
    for now[0] in (0, 29, 30, 31):
        cached.get()
    assert len(loads) == 2
    cached.forget()
    cached.get()
    assert len(loads) == 3
    table.createOrReplaceTempView("bound_quads")
    query, args = quads.bind("SELECT count(*) AS n FROM bound_quads WHERE graph = :g AND object <> ':x'", g="published")
    assert spark.sql(query, args=args).first()["n"] == table.count()
    for wrong in ({}, {"g": "x", "h": "y"}, {"g": ["x"]}):
        with pytest.raises(ValueError):
            quads.bind(query, **wrong)
    assert quads.matching(table, graph="published", predicate="<http://www.w3.org/2004/02/skos/core#broader>").count() == 1
    assert spark.createDataFrame([('"a\\n\\"b\\\\n"@en',), ("<x>",)], "t string").select(quads.lexical(F.col("t")).alias("t")).collect()[0]["t"] == 'a\n"b\\n'

"""Registers, vectors, the gap queue, browsing, previews, ingestion, steps after a publication, telemetry, checks, streams."""

import datetime
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from termlake.operators import checks, fanout, gaps, impact, ingestion, publishing, registry, resolution, runs, telemetry, vectors, vocabulary
from termlake.sources import quads, turtle
from termlake.streaming import events

TTL = """@prefix skos: <http://www.w3.org/2004/02/skos/core#> .
@prefix dct: <http://purl.org/dc/terms/> .
@prefix ex: <http://example.org/> .
@prefix t: <http://example.org/machine/> .
ex:equipment a skos:ConceptScheme ; dct:title "Equipment"@en , "Geräte"@de .
ex:telemetry a skos:ConceptScheme .
ex:part a skos:Concept ; skos:inScheme ex:equipment ; skos:topConceptOf ex:equipment ; skos:prefLabel "part"@en ; skos:definition "a part"@en .
ex:other a skos:Concept ; skos:inScheme ex:equipment ; skos:topConceptOf ex:equipment ; skos:prefLabel "other"@en ; skos:definition "d"@en .
ex:filter a skos:Concept ; skos:inScheme ex:equipment ; skos:broader ex:part ; skos:prefLabel "filter"@en , "Filter"@de ; skos:altLabel "sieve"@en ;
  skos:definition "keeps"@en ; skos:related ex:other ; skos:notation "F1" .
ex:fine a skos:Concept ; skos:inScheme ex:equipment ; skos:broader ex:filter ; skos:prefLabel "fine filter"@en ; skos:definition "d"@en .
t:f a skos:Concept ; skos:inScheme ex:telemetry ; skos:topConceptOf ex:telemetry ; skos:prefLabel "machine f"@en ; skos:notation "flt" ; skos:closeMatch ex:filter ; skos:exactMatch ex:fine ; skos:definition "d"@en .
t:g a skos:Concept ; skos:inScheme ex:telemetry ; skos:topConceptOf ex:telemetry ; skos:prefLabel "machine g"@en ; skos:notation "gone" ; skos:definition "d"@en .
"""
EX = "http://example.org/"
DOCS = [("a.md", "1", "manual", False, "# Set\n\ngas bottle | service interval | 6 months\nfilter | flow rate | 2.4 L/min\n"), ("b.md", "1", "bulletin", False, "Gas bottles : service interval : 4 months\nFilter : flow rate : 2.4 L/min\nnothing here\n"), ("c.html", "1", "sheet", True, "<p>fine filter | price | &pound;12</p>\n<!-- x\n--><p>sieve | flow rate | 1.8 L/min</p>")]
DOC = "source_file string, doc_version string, doc_type string, is_html boolean, text string"


def at(minute):
    return datetime.datetime(2024, 1, 1, 0, minute, tzinfo=datetime.UTC)


@pytest.fixture(scope="module")
def published(spark):
    return turtle.read_turtle(spark, {"a.ttl": TTL}, "published").cache()


@pytest.fixture(scope="module")
def views(published):
    return publishing.views(published)


def test_registry(spark, tmp_path):
    manifest = {"documents": [{"filename": "a", "doc_type": "x", "doc_version": v, "issued": "2024", "format": "html", "authority": "official", "applies_to": ["m"]} for v in ("9", "10")] + [{"filename": "b", "doc_type": "x", "doc_version": "1"}], "seeded_gap": {"surface_form": "x"}}
    (tmp_path / "m.json").write_text(json.dumps(manifest, indent=1))
    rows = registry.load_manifest(spark, f"file://{tmp_path}/m.json")
    assert rows.collect() == registry.parse_manifest(spark, json.dumps(manifest)).collect() and rows.count() == 3
    once = registry.register(rows.limit(0), rows)
    assert sorted(map(str, registry.register(once, rows).collect())) == sorted(map(str, once.collect()))
    assert [r["filename"] for r in registry.registered(once).collect()] == ["a", "a", "b"]
    assert {r["filename"]: r["doc_version"] for r in registry.newest(once).collect()} == {"a": "9", "b": "1"}  # text order
    with pytest.raises(Exception, match="may not be empty"):
        registry.register(once, rows.withColumn("filename", F.lit(""))).collect()
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a").write_text("über")
    (tmp_path / "t" / "c").write_text("c")
    texts = registry.raw_texts(spark, f"file://{tmp_path}/t")
    assert [(r["filename"], r["text"]) for r in registry.documents(once, texts, ["a"]).collect()] == [("a", "über")]
    with pytest.raises(registry.UnknownDocument, match="zzz"):
        registry.documents(once, texts, ["a", "zzz"])
    assert {tuple(r) for r in registry.compare(once, texts).collect()} == {("b", "is registered but not present"), ("c", "is present but not registered")}
    assert {tuple(r) for r in registry.incomplete(once).collect()} == {("b", "issued"), ("b", "format"), ("b", "authority")}


def test_vectors(spark):
    chunks = spark.createDataFrame([("a", "m", "1", 1, 3, "x" * 1200, ["q", "p", "q"]), ("a", "m", "1", 4, 5, "y", None)], "source_file string, doc_type string, doc_version string, start_line int, end_line int, text string, concepts array<string>")
    rows = vectors.chunk_vectors(chunks, F.array(F.lit(1.0), F.col("start_line").cast("double")))
    assert {(r["key"], len(r["snippet"]), tuple(r["concepts"])) for r in rows.collect()} == {("a#1-3", 1000, ("p", "q")), ("a#4-5", 1, ())}
    again = vectors.put(rows, rows.withColumn("doc_type", F.lit("n")).where("line_range = '1-3'"))
    assert sorted((r["key"], r["doc_type"]) for r in again.collect()) == [("a#1-3", "n"), ("a#4-5", "m")]
    assert vectors.delete(again, spark.createDataFrame([("a#1-3",), ("none",)], "key string")).count() == 1
    assert vectors.matching() is None
    assert [r["key"] for r in vectors.nearest(rows, [0.0, 1.0], 1).collect()] == ["a#4-5"]
    assert [r["key"] for r in vectors.nearest(rows, [0.0, 1.0], 2, vectors.matching(["p", "z"], "a")).collect()] == ["a#1-3"]
    assert vectors.nearest(rows, [0.0, 1.0], 2, vectors.matching(["p"], "b")).count() == 0


def test_nearest_filtered_against_brute_force(spark):
    rows = [(i, [float(i % 7), float(i % 5) / 3], sorted({"abc"[i % 3], "abc"[i // 3 % 3]})) for i in range(60)]
    stored = spark.createDataFrame(rows, "key bigint, vector array<double>, concepts array<string>")
    asked = stored.where("key % 10 = 0").withColumnRenamed("key", "query_id")
    want = []
    for q, v, c in rows[::10]:
        near = sorted((round(1 - sum(x * y for x, y in zip(v, w, strict=True)), 6), k) for k, w, d in rows if k != q and set(c) & set(d))[:5]
        want += [(q, n, k, d) for n, (d, k) in enumerate(near, 1)]
    assert sorted(tuple(r) for r in vectors.nearest_filtered(asked, stored, 5, 4).collect()) == sorted(want)


def test_cascade(spark):
    labels = spark.createDataFrame([("filter", "s", "Filter", "pref"), ("sieve", "s", "sieve", "alt"), ("a", "s", "both", "pref"), ("b", "t", "both", "pref"), ("m", "telemetry", "flt", "pref")], "concept_id string, scheme_id string, label string, kind string")
    index = resolution.build_index(labels)
    vector = lambda x: [x, (1 - x * x) ** 0.5]
    near = [("l1", "c1", "s", vector(0.95)), ("l2", "c1", "s", vector(0.94)), ("l3", "c2", "s", vector(0.6)), ("l4", "c3", "telemetry", vector(1.0))]
    schema = "label string, concept_id string, scheme_id string, label_vector array<double>"
    mentions = spark.createDataFrame([(1, "FILTER"), (2, "both"), (3, "gas"), (4, "…"), (5, "fltre"), (6, "flt"), (7, None)], "id int, surface string")
    aliases = spark.createDataFrame([("fltre", "filter")], "original string, corrected string")
    embed = lambda text: F.array(F.lit(1.0), F.lit(0.0))
    out = {r["id"]: r for r in resolution.resolve(mentions, index, spark.createDataFrame(near, schema), aliases, embed).collect()}
    said = lambda i: (out[i]["concept_id"], out[i]["stage"], out[i]["label_kind"])
    assert [said(i) for i in range(1, 8)] == [("filter", "exact", "pref"), (None, "abstain", None), ("c1", "embedding", None), (None, "abstain", None), ("filter", "exact", "alias"), ("m", "exact", "pref"), (None, "abstain", None)]
    assert out[2]["collision"] == ["a", "b"] and out[5]["surface"] == "fltre" and out[5]["lookup"] == "filter"
    assert [(x["concept_id"], x["label"], x["score"]) for x in out[3]["shortlist"]] == [("c1", "l1", 0.95), ("c2", "l3", 0.6)]  # best label, no machine
    close = spark.createDataFrame([near[0], ("l3", "c2", "s", vector(0.91))], schema)
    tied = resolution.resolve(mentions.where("id = 3"), index, close, None, embed).first()
    assert (tied["stage"], tied["score"], len(tied["shortlist"])) == ("abstain", 0.95, 2)
    assert resolution.resolve(mentions, index).where("stage = 'exact'").count() == 2
    with pytest.raises(resolution.Collision, match="both"):
        resolution.build_index(labels.withColumn("scheme_id", F.lit("s")))
    assert resolution.known_instances(mentions, spark.createDataFrame([("flt",)], "surface string"), "surface").count() == 1


def test_aliases(spark):
    labels = spark.createDataFrame([(x, "s", x, "pref") for x in ("filter", "gas", "co2 cylinder", "installation")], "concept_id string, scheme_id string, label string, kind string")
    index = resolution.label_index(labels)
    pairs = [("filter", "sieve"), ("bouteille de gaz", "co2 cylinder"), ("bouteille de gaz", "gas bottle"), ("filtre", "filter")]
    kept = resolution.prune_aliases(spark.createDataFrame(pairs, "original string, corrected string"), index)
    assert {tuple(r) for r in kept.collect()} == {("bouteille de gaz", "gas bottle"), ("filtre", "filter")}
    words = spark.createDataFrame([(w,) for w in ("installtion", "filtre", "gaz", "xyz", "filter")], "word string")
    found = resolution.close_aliases(words, spark.createDataFrame([(w,) for w in ("installation", "filter", "gas", "gap")], "word string"))
    assert {tuple(r) for r in found.collect()} == {("installtion", "installation"), ("filtre", "filter"), ("gaz", "gas")} or {tuple(r) for r in found.collect()} == {("installtion", "installation"), ("filtre", "filter")}
    vector = spark.range(1).select(resolution.hash_embedding(F.lit("Gas bottle")).alias("a"), resolution.hash_embedding(F.lit("gas  BOTTLE")).alias("b"), resolution.hash_embedding(F.lit("")).alias("c")).first()
    assert vector["a"] == vector["b"] and abs(sum(x * x for x in vector["a"]) - 1) < 1e-9 and set(vector["c"]) == {0.0}


def test_many_labels_in_blocks(spark):
    rows = [(i, [float(i % 7), float(i % 3)]) for i in range(20)]
    asked = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    labels = spark.createDataFrame([(f"l{i:02}", [float(i % 5), float(i % 4)]) for i in range(30)], "label string, label_vector array<double>")
    key = lambda df: sorted(tuple(r) for r in df.select("vec_id", "rank", "label", "score").collect())
    assert key(resolution.nearest_labels(asked, labels, 5, tile_bytes=64)) == key(resolution.nearest_labels(asked, labels, 5))
    want = []
    for q, (x, y) in rows:
        near = sorted((-round(x * (i % 5) + y * (i % 4), 4), f"l{i:02}") for i in range(30))[:5]
        want += [(q, n, label, -s) for n, (s, label) in enumerate(near, 1)]
    assert key(resolution.nearest_labels(asked, labels, 5, tile_bytes=64)) == sorted(want)
    empty = asked.limit(0)
    assert resolution.nearest_labels(empty, labels).count() == 0 and resolution.nearest_labels(asked, labels.limit(0)).count() == 0


@pytest.mark.parametrize("tile_bytes", [48, 1 << 20])
def test_concepts_by_their_best_label_in_tiles(spark, tile_bytes):
    rows = [(f"l{i % 23:02}", f"c{i % 7}", "telemetry" if i % 11 == 0 else "s", [float(i % 5), float(i % 4)] if i != 3 else None) for i in range(40)]
    labels = spark.createDataFrame(rows, "label string, concept_id string, scheme_id string, label_vector array<double>")
    asked = spark.createDataFrame([(i, [i % 7 / 3, i % 3 / 7]) for i in range(9)] + [(99, None)], "vec_id int, embedding array<double>")
    want = []
    for q in range(9):
        best = {}
        for label, concept, scheme, v in rows:
            if v and scheme == "s":
                score = (-float(round(Decimal(repr(q % 7 / 3 * v[0] + q % 3 / 7 * v[1])), 4)), label)
                best[concept] = min(best.get(concept, score), score)
        want += [(q, n, c, label, -s) for n, (s, label, c) in enumerate(sorted((s, label, c) for c, (s, label) in best.items())[:3], 1)]
    found = resolution.nearest_concepts(asked, labels, 3, tile_bytes=tile_bytes)
    assert sorted(tuple(r) for r in found.select("vec_id", "rank", "concept_id", "label", "score").collect()) == sorted(want)


def miss(surface, source, locator, minute, merge_as=None, text="t", kind=gaps.ADD_LABEL, suggestions=None):
    return (surface, merge_as, source, text, locator, None, at(minute), kind, suggestions, None, "r")


def test_gap_queue_compacted(spark, tmp_path):
    """Snapshots and what came since read as the whole log does, whatever is compacted and pruned when."""
    plain, queue = (gaps.GapQueue(spark, f"file://{tmp_path}/{x}") for x in ("plain", "compacted"))
    assert queue.compact() == 0 and queue.list().count() == 0
    batches = [
        [miss("gas bottles", "ingestion", "a:1", 1), miss("Gas bottle", "ingestion", "a:1", 2, suggestions=[("co2", "CO2 Cylinder", 0.3)])],
        [miss("bouteille", "chat", "chat:x", 3, merge_as="gas bottle"), miss("valve", "chat", "chat:y", 3)],
        [miss("gas bottle", "ingestion", f"a:{i}", i % 9) for i in range(30)],
        [miss("Gas bottle", "ingestion", "a:1", 7, text="later")],
    ]
    for i, rows in enumerate(batches):
        for q in (plain, queue):
            q.record(spark.createDataFrame(rows, gaps.MISS))
        if i < 3:
            assert queue.compact() == i + 1 == queue.compact()
        if i == 1:
            assert queue.prune() == 2 and queue.prune() == 0
    key = lambda df: sorted(str(r.asDict(recursive=True)) for r in df.collect())
    assert key(queue.entries()) == key(plain.entries()) and key(queue.evidence()) == key(plain.evidence())
    assert queue.read("gas bottle")["total"] == 34 and queue.exists("valve") and not queue.exists("pipe")
    assert queue.misses().count() == 31 and plain.misses().count() == 35


def test_gap_queue(spark, tmp_path):
    queue = gaps.GapQueue(spark, f"file://{tmp_path}/gaps", lambda: at(30))
    queue.record(spark.createDataFrame([miss("gas bottles", "ingestion", "a:1", 1), miss("Gas bottle", "ingestion", "a:1", 2, suggestions=[("co2", "CO2 Cylinder", 0.3)]), miss("bouteille", "chat", "chat:x", 3, merge_as="gas bottle")], gaps.MISS))
    (row,) = queue.list().collect()
    assert (row["gap_key"], row["surface_form"], row["total"], row["counts"], row["n_variants"]) == ("gas bottle", "gas bottles", 3, {"chat": 1, "ingestion": 2}, 3)
    assert (row["first_seen"].minute, row["last_seen"].minute, row["variants"]) == (1, 3, ["Gas bottle", "bouteille", "gas bottles"])
    assert [(r["source"], r["rank"], r["locator"], r["at"].minute) for r in queue.evidence().orderBy("source").collect()] == [("chat", 1, "chat:x", 3), ("ingestion", 1, "a:1", 2)]
    assert queue.exists("gas bottle") and not queue.exists("none") and queue.read("none") is None and queue.dismiss("none", "x") is None
    assert queue.dismiss("gas bottle", "noise")["status"] == "dismissed"
    assert queue.list().count() == 0 and queue.list(None).count() == 1
    queue.clock = lambda: at(31)
    queue.record(spark.createDataFrame([miss("gas bottle", "chat", f"chat:{i}", 4) for i in range(296)], gaps.MISS))
    assert queue.list().count() == 0
    queue.record(spark.createDataFrame([miss("gas bottle", "chat", "chat:z", 5)], gaps.MISS))
    (row,) = queue.list().collect()
    assert row["resurfaced"] and row["total"] == 300
    assert queue.resurface() == 1 and queue.resurface() == 0
    assert queue.read("gas bottle")["status"] == "open"
    queue.clock = lambda: at(32)
    queue.close(spark.createDataFrame([("gas bottle", "co2")], "gap_key string, concept_id string"), "publish-1")
    assert (queue.read("gas bottle")["status"], queue.read("gas bottle")["concept_id"]) == ("actioned", "co2")
    queue.clock = lambda: at(33)
    queue.reopen(queue.entries())
    assert queue.read("gas bottle")["status"] == "open"
    with pytest.raises(Exception, match="names no term"):
        gaps.keyed(spark.createDataFrame([miss("…", "chat", "x", 1)], gaps.MISS)).collect()


def test_gap_questions(spark):
    rows = [("x", gaps.ADD_LABEL, {"ingestion": 2, "chat": 1}, [("c", "Filter", 0.5)], None), ("x", gaps.NEW_CONCEPT, {"chat": 1}, [], None), ("x", gaps.NEW_CONCEPT, {"chat": 1}, [], "fault"), ("x", gaps.ADD_MAPPING, {}, [("c", "Filter", 0.5)], None), ("x", gaps.ADD_LABEL, {"chat": 2}, [], None)]
    df = spark.createDataFrame(rows, f"surface_form string, gap_type string, counts map<string,bigint>, suggestions {gaps.SUGGESTIONS}, suggested_scheme string")
    assert [r["q"] for r in df.select(gaps.question().alias("q")).collect()] == [
        "**x**: 1 chat mention and 2 ingestion mentions. Closest term: **Filter**.", "**x**: 1 chat mention, matches nothing. Closest scheme: **no scheme**.",
        "**x**: 1 chat mention, matches nothing. Closest scheme: **fault**.", "Signal **x** looks like **Filter**.", "**x**: 2 chat mentions.",
    ]
    assert df.select(gaps.target().alias("t")).first()["t"] == ("c", "x")
    asked = spark.createDataFrame([(" Q? ", "Bouteille", "gas bottle", []), (" Q? ", "Gas", "gas", [])], f"question string, surface string, lookup string, shortlist {gaps.SUGGESTIONS}")
    made = gaps.chat_misses(asked, F.lit(at(1))).collect()
    assert [(r["merge_as"], r["text"]) for r in made] == [("gas bottle", "Q?"), (None, "Q?")] and made[0]["locator"] == made[1]["locator"] and len(made[0]["locator"]) == 17


def test_browsing(views, published):
    schemes, top = vocabulary.scheme_tree(views)
    assert [(r["scheme_id"], r["title"], r["concept_count"]) for r in schemes.collect()] == [(f"{EX}equipment", "Equipment", 4)]
    assert [(r["concept_id"], r["pref_label"], r["child_count"]) for r in top.collect()] == [(f"{EX}other", "other", 0), (f"{EX}part", "part", 1)]
    assert vocabulary.scheme_tree(views, include_machine=True)[0].count() == 2
    card = vocabulary.concept_detail(views).where(F.col("concept_id") == f"{EX}filter").first()
    assert (card["pref_label"], card["alt_labels"], card["notation"], card["version"], card["is_top"]) == ({"en": "filter", "de": "Filter"}, ["sieve"], "F1", 1, False)
    assert (card["parent"]["pref_label"], [r["pref_label"] for r in card["related"]], card["child_count"], card["definition"]) == ("part", ["other"], 1, {"en": "keeps"})
    signals = {(r["concept_id"], r["match"], r["notation"]) for r in vocabulary.machine_signals(views).collect()}
    assert signals == {(f"{EX}filter", "closeMatch", "flt"), (f"{EX}fine", "exactMatch", "flt")}
    kids = vocabulary.children(views.broader, views.concepts, resolution.english_names(views.labels)).collect()
    assert [(r["parent"], r["pref_label"], r["child_count"]) for r in kids] == [(f"{EX}filter", "fine filter", 0), (f"{EX}part", "filter", 1)]
    moving = views.concepts.select(F.lit(f"{EX}part").alias("root")).limit(1)
    names = resolution.english_names(views.labels)
    offered = lambda **k: [r["pref_label"] for r in vocabulary.parent_candidates(moving, views.concepts, names, views.broader, **k).collect()]
    assert offered() == ["other"] and offered(machine=(), top_only=False) == ["machine f", "machine g", "other"]
    assert vocabulary.describe(published, f"{EX}fine").count() == 5
    assert vocabulary.labels_in_order(views.labels).first()["concept_id"] == f"{EX}filter"


def test_preview(spark, views):
    held = spark.createDataFrame([("c1", "gas bottle", "a", "1-1"), ("c2", "gas bottle", "a", "3-3"), ("c3", "gas bottle", "b", "1-1"), ("c4", "other thing", "b", "2-2")], "claim_id string, gap_key string, source_file string, line_range string")
    drafts = spark.createDataFrame([("d1", f"{EX}filter", None, f"{EX}other", ["Gas bottles", "gas bottle", "Part"]), ("d2", f"{EX}new", f"{EX}telemetry", None, ["part"]), ("d3", f"{EX}fine", None, f"{EX}filter", [None, "…"])], "draft_id string, concept_id string, scheme_id string, parent string, labels array<string>")
    names = resolution.english_names(views.labels)
    out = {r["draft_id"]: r for r in impact.preview(drafts, held, views.labels, names, views.broader).collect()}
    assert out["d1"]["surfaces"] == ["gas bottle", "part"]
    assert out["d1"]["sentence"] == "Adding this alternative term will resolve 3 mentions across 2 documents."
    assert (out["d1"]["gained"], out["d1"]["lost"], out["d1"]["n_findings"]) == (f"{EX}other", f"{EX}part", 1)
    assert (out["d2"]["sentence"], out["d2"]["n_findings"], out["d3"]["gained"], out["d3"]["surfaces"]) == ("", 0, None, [])
    assert [r["claim_id"] for r in impact.mentions(held, drafts).collect()] == ["c1", "c2", "c3"]
    assert [(r["draft_id"], r["message"]) for r in impact.collisions(drafts, views.labels, names).collect()] == [("d1", "“part” is already a term for part.")]


def test_ingestion_twice(spark, views):
    docs = spark.createDataFrame(DOCS, DOC)
    index = resolution.build_index(views.labels)
    empty = spark.createDataFrame([], ", ".join(f"{c} {'double' if c in ('confidence', 'resolution_score') else 'string'}" for c in ingestion.CLAIM))
    first = ingestion.ingest(docs, index, empty, run_id="r")
    claims = {(r["subject_surface"], r["status"], r["gap_key"], r["source_file"], r["line_range"], r["value"]) for r in first.claims.collect()}
    assert claims == {
        ("gas bottle", "held", "gas bottle", "a.md", "3-3", "6 months"), ("filter", "active", None, "a.md", "4-4", "2.4 L/min"), ("Gas bottles", "held", "gas bottle", "b.md", "1-1", "4 months"),
        ("Filter", "active", None, "b.md", "2-2", "2.4 L/min"), ("fine filter", "active", None, "c.html", "1-1", "£12"), ("sieve", "active", None, "c.html", "3-3", "1.8 L/min"),
    }
    groups = {}
    ids = {r["claim_id"]: (r["subject_surface"], r["value"]) for r in first.claims.collect()}
    for r in first.conflicts.collect():
        groups.setdefault(r["group_key"], set()).add(ids[r["claim_id"]])
    assert sorted(map(sorted, groups.values())) == [[("Filter", "2.4 L/min"), ("filter", "2.4 L/min"), ("sieve", "1.8 L/min")], [("Gas bottles", "4 months"), ("gas bottle", "6 months")]]
    assert ingestion.conflict_pairs(first.conflicts).count() == 3 * 2 + 2
    tags = {(r["source_file"], r["start_line"]): r["concepts"] for r in first.chunks.collect()}
    assert tags == {("a.md", 1): [f"{EX}filter"], ("b.md", 1): [f"{EX}filter"], ("c.html", 1): [f"{EX}filter", f"{EX}fine"]}
    again = ingestion.ingest(docs, index, first.claims, run_id="r")
    assert sorted(map(str, again.claims.collect())) == sorted(map(str, first.claims.collect())) and again.retracted.count() == 6
    n = ingestion.counts(first, 3)
    assert n == {"documents": 3, "chunks": 3, "vectors": 3, "facts_extracted": 6, "claims_active": 4, "claims_held": 2, "conflicts": 2, "gaps": 2, "rejections": 0}
    assert [name for name, _ in ingestion.steps(n)] == ["register", "chunk_and_index", "extract", "resolve", "detect_conflicts", "persist"]
    assert ingestion.merged([n, n])["chunks"] == 6
    facts = ingestion.to_quads(first.claims, EX, ingestion.conflict_pairs(first.conflicts))
    assert facts.where("predicate like '%conflictsWith>'").count() == 8 and facts.where("predicate like '%heldSurface>'").count() == 2
    assert facts.where("graph <> 'facts'").count() == 0 and facts.where("predicate like '%unit>'").count() == 0
    assert ingestion.read_claims(first.claims, f"{EX}fine").count() == 1 and ingestion.read_claims(first.claims).first()["predicate"] == "flow rate"

    def wrong(chunks):
        rows = [("a.md", 0, "gas", "p", "1", None, "not in there", 0.8), ("a.md", 0, "…", "p", "1", None, "gas bottle", 0.8), ("a.md", 0, "gas", "p", "1", None, " ", 0.8), ("a.md", 0, "gas", None, "1", None, "gas bottle", 0.8), ("a.md", 0, "gas", "p", "1", None, "gas  bottle\n| service", 0.8)]
        return spark.createDataFrame(rows, "source_file string, chunk_no int, subject string, predicate string, value string, unit string, snippet string, confidence double")

    gate = ingestion.ingest(docs, index, empty, wrong)
    assert sorted(r["reason"] for r in gate.rejections.collect()) == ["empty snippet", "empty subject", "not a fact", "snippet not in the source"]
    assert gate.claims.count() == 1


def test_after_publication(spark, published, tmp_path):
    root = f"file://{tmp_path}"
    log, queue = runs.RunLog(spark, f"{root}/log"), gaps.GapQueue(spark, f"{root}/gaps")
    w = fanout.Workspace(spark, root, log, queue, lambda: spark.createDataFrame(DOCS, DOC))
    with pytest.raises(RuntimeError):
        fanout.run_step(w, "reresolve_gaps", {})
    with pytest.raises(fanout.UnknownStep):
        fanout.run_step(w, "none", {})
    quads.publish(published, w.vocabulary, 0)
    fanout.start_ingest(w, "i1")
    assert log.run("i1")["status"] == "queued"
    n = fanout.ingest(w, "i1")
    assert (n["claims_held"], log.run("i1")["status"], len(log.run("i1")["steps"])) == (2, "succeeded", 6)
    assert w.index.watermark() == quads.digest(w.quads())
    with pytest.raises(ValueError, match="zzz"):
        fanout.ingest(w, "i2", ["zzz"])
    assert log.run("i2")["status"] == "failed"
    draft = publishing.Draft(f"{EX}part", alt=["gas bottles"])
    done = publishing.publish(log, w.vocabulary, draft, "me", gaps=queue.entries())
    assert (done["surfaces"], done["closes"], done["history"]) == (["gas bottle"], ["gas bottle"], "")
    counts = fanout.after_publication(w, {"run_id": done["run_id"], "concept_id": f"{EX}part"}, wait=0)
    assert (counts["mentions_resolved"], counts["gaps_closed"], counts["documents_reindexed"]) == (2, 1, 2)
    run = log.run(done["run_id"])
    assert (run["status"], run["note"]) == ("succeeded", "2 mentions resolved · 2 documents reindexed · 1 gap closed")
    assert w.table("claims").where("status = 'held'").count() == 0
    assert {tuple(r["concepts"]) for r in w.table("vectors").where("source_file = 'a.md'").collect()} == {(f"{EX}filter", f"{EX}part")}
    assert queue.read("gas bottle")["status"] == "actioned"
    assert fanout.full_reset(w, published, "x", dry_run=True)["gaps_reopened"] == 1 and queue.read("gas bottle")["status"] == "actioned"
    fanout.full_reset(w, published, "x")
    assert w.table("claims").where("status = 'held' and gap_key = 'gas bottle'").count() == 2
    assert queue.read("gas bottle")["status"] == "open" and log.run("x")["status"] == "succeeded"


KV = lambda k, **v: {"key": k, "value": v}
PAYLOAD = {
    "resourceMetrics": [{"resource": {"attributes": [KV("device.id", stringValue="d1")]}, "scopeMetrics": [{"scope": {"name": "s"}, "metrics": [
        {"name": "flow", "unit": "L/min", "gauge": {"dataPoints": [{"asDouble": 2.5, "timeUnixNano": "1704067200123456789", "attributes": [KV("component.type", stringValue="flt"), KV("n", intValue="7")]}]}},
        {"name": "total", "sum": {"isMonotonic": True, "aggregationTemporality": 2, "dataPoints": [{"asInt": str(v), "timeUnixNano": f"170406720{i}000000000", "attributes": []} for i, v in enumerate((5, 8, 2))]}}]}]}],
    "resourceLogs": [{"resource": {"attributes": [KV("device.id", stringValue="d2")]}, "scopeLogs": [{"scope": {"name": "s"}, "logRecords": [{"timeUnixNano": "1704067201000000000", "severityText": "WARN", "body": {"stringValue": "b"}, "attributes": [KV("fault.code", stringValue="E\"42"), KV("fault.type", stringValue="gone")]}]}]}],
}


def test_telemetry(spark, views, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps(PAYLOAD, indent=2))
    payloads = telemetry.read_payloads(spark, f"file://{tmp_path}/p.json")
    points = telemetry.points(payloads)
    gauge = points.where("kind = 'gauge'").first()
    assert (gauge["metric"], gauge["value"], gauge["attributes"], gauge["resource"]["device.id"], gauge["at"].microsecond) == ("flow", 2.5, {"component.type": "flt", "n": "7"}, "d1", 123456)
    added = telemetry.increments(points.where("kind = 'sum'"), ["metric"]).orderBy("at")
    assert [r["increment"] for r in added.collect()] == [None, 3.0, 2.0]
    records = telemetry.logs(payloads)
    both = points.select("attributes", "resource", "at").unionByName(records.select("attributes", "resource", "at"))
    tokens = telemetry.tokens(both)
    walked = spark.createDataFrame([(json.dumps(PAYLOAD),)], "x string").select(F.explode(telemetry.text_attributes(F.col("x"))).alias("p")).select("p.*")
    assert {tuple(r) for r in walked.where("key like '%.type' or key = 'fault.code'").collect()} == {(r["key"], r["token"]) for r in tokens.collect()} == {("component.type", "flt"), ("fault.code", 'E"42'), ("fault.type", "gone")}
    notations = views.facts.where("predicate like '%notation>'").select("concept_id", F.col("value").alias("token"))
    known = telemetry.mapping(notations, views.links)
    assert {(r["token"], r["concept_id"], r["match"]) for r in known.where("token <> 'F1'").collect()} == {("flt", f"{EX}fine", "exactMatch"), ("gone", None, None)}
    signals = telemetry.mapped(tokens, known)
    lost = telemetry.unmapped(signals)
    assert {tuple(r) for r in lost.collect()} == {('E"42', 1, 1), ("gone", 1, 1)}
    expected = spark.createDataFrame([("gone",), ("limescale",)], "token string")
    assert {tuple(r) for r in telemetry.expectations(lost, expected).collect()} == {('E"42', "unexpected"), ("limescale", "missing")}
    entries = gaps.entries(telemetry.unmapped_misses(signals, "fault")).collect()
    assert {(r["gap_key"], r["gap_type"], r["suggested_scheme"]) for r in entries} == {("e 42", "NewConcept", "fault"), ("gone", "NewConcept", "fault")}
    assert telemetry.fleet(signals, f"{EX}fine").count() == 1 and telemetry.fleet(signals, f"{EX}fine", "d9").count() == 0
    now = F.lit(datetime.datetime(2024, 1, 31, 0, 0, 1, tzinfo=datetime.UTC))
    assert telemetry.unexpired(tokens, "at", 30, now).count() == 0 or telemetry.unexpired(tokens, "at", 30, now).count() == 2
    assert telemetry.unexpired(tokens, "at", 31, now).count() == 3


def test_checks(spark, views):
    rows = [("a", "md", False, "raw", "gas bottle  and gas\nbottle; the filter is 6 months"), ("b", "html", True, "&pound;1 <b>", "£1 part 4 months fine filter")]
    docs = spark.createDataFrame(rows, "source_file string, f string, is_html boolean, raw string, text string")
    held = registry.parse_manifest(spark, json.dumps({"documents": [{"filename": x, "doc_type": "t", "doc_version": "1", "issued": "i", "format": "f", "authority": "a"} for x in "ab"]}))
    present = docs.select(F.col("source_file").alias("filename"))
    sides = spark.createDataFrame([("i", "a", "6 months"), ("i", "b", "4 months")], "subject string, source string, value string")
    business = views.labels.where("scheme_id like '%equipment'").select("concept_id", "label")
    assert checks.corpus(held, present, docs, sides, business, "gas bottle", 2, 1, least=3).collect() == []
    bad = checks.corpus(held, present.limit(1), docs.withColumn("text", F.lit("<b> &amp;")), sides.where("source = 'a'"), business, "part", 2, 1)
    assert {r["check"] for r in bad.collect()} == {"registry", "contradiction", "gap", "html", "coverage"}
    assert ingestion.vocabulary_coverage(business, docs).first().asDict() == {"concepts": 4, "mentioned": 3, "percent": 75}
    assert ingestion.vocabulary_coverage(business, docs, most=1).first()["mentioned"] == 3
    assert checks.word_totals(docs).first().asDict() == {"documents": 2, "words": 16}
    cards = spark.createDataFrame([(f"{EX}filter", publishing.skos("altLabel"), "sieve"), (f"{EX}filter", publishing.skos("definition"), None)], "concept_id string, predicate string, value string")
    tokens = spark.createDataFrame([("E42",)], "token string")
    assert checks.vocabulary(views, ["gas bottle"], ["scal"], tokens, tokens, cards).collect() == []
    wrong = checks.vocabulary(views, ["sieve"], ["filt"], tokens, tokens.limit(0), cards.withColumn("value", F.lit("x")))
    assert {r["check"] for r in wrong.collect()} == {"gap", "mapping", "card"}
    assert checks.concepts_per_scheme(views.concepts).count() == 2
    assert {tuple(r) for r in checks.warning_histogram(publishing.G.gate_views(views)).collect()} == set()


def test_streams(spark, tmp_path):
    rows = [(i, at(0) + datetime.timedelta(minutes=m), i % 3, ("view", "click")[i % 2], float(i)) for i, m in enumerate([0, 1, 70, 80, 190, 600, 601, 1000])]
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
    table = spark.createDataFrame([*rows, rows[0]], schema)
    table.write.parquet(f"file://{tmp_path}/events")
    stream = events.read_events(spark, f"file://{tmp_path}/events", schema)

    def ran(df, mode, name):
        df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name)

    twin = {tuple(r) for r in events.hourly(table).collect()}
    final = {tuple(r) for r in ran(events.hourly_stream(stream), "append", "hours").collect()}
    assert final < twin and len(twin) - len(final) <= 1  # all but the hour that is still open
    assert ran(events.deduplicated(stream, ["event_id"]), "append", "once").count() == len(rows)
    assert {(r["event_type"], r["n"]) for r in ran(events.counts_stream(stream, ["event_type"]), "complete", "counts").collect()} == {("view", 5), ("click", 4)}
    points = spark.createDataFrame([("s", at(i), v) for i, v in enumerate((1.0, 4.0, 2.0))], "series string, ts timestamp, value double")
    assert [r["increment"] for r in events.increments(points).orderBy("ts").collect()] == [0.0, 3.0, 2.0]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.json").write_text(json.dumps(PAYLOAD))
    tokens = telemetry.tokens(telemetry.points(events.payload_stream(spark, f"file://{tmp_path}/in")))
    mapping = spark.createDataFrame([("flt", "c", "exactMatch")], "token string, concept_id string, match string")
    out = []
    events.mapped_batches(tokens, lambda: mapping, lambda batch, n: out.extend(batch.collect()), f"file://{tmp_path}/mapped").awaitTermination(120)
    assert [(r["token"], r["concept_id"], r["device"]) for r in out] == [("flt", "c", "d1")]

"""Queries of registers, resolution, the gap queue, browsing, ingestion and telemetry over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlake.functions import text as T
from termlake.functions import units as U
from termlake.operators import checks as K
from termlake.operators import gaps as Q
from termlake.operators import graph as G
from termlake.operators import impact as P
from termlake.operators import ingestion as I
from termlake.operators import publishing, telemetry, vocabulary
from termlake.operators import registry as Y
from termlake.operators import resolution as R
from termlake.plans import core
from termlake.plans.core import DOC_WORDS, LABELS, MISSES, Query, key, norm, t, raw_misses
from termlake.sources import quads as S

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


@query(f"""WITH k AS (SELECT DISTINCT concept_id, scheme_id, {norm('label')} AS label_key FROM {LABELS}), s AS (SELECT scheme_id, label_key FROM k GROUP BY 1, 2 HAVING count(*) > 1)
  SELECT DISTINCT concept_id FROM k JOIN s USING (scheme_id, label_key)""")
def resolver_parity(spark, d):
    return G.sharing(core.part_labels(spark, d), T.normalise(F.col("label")))


@query(f"SELECT DISTINCT {norm('label')} AS label_key, concept_id, scheme_id FROM {LABELS}")
def label_owners(spark, d):
    return R.owners(core.part_labels(spark, d)).select("label_key", "concept_id", "scheme_id")


PREDICATES = "(SELECT DISTINCT p_brand || CASE p_size % 4 WHEN 0 THEN ' Interval' WHEN 1 THEN '_rate' ELSE '' END AS p FROM part UNION SELECT unnest(['Replacement Interval', 'service  interval', 'Flow-rate', 'DISPENSE RATE', 'change interval', 'Retail price', '', 'É tat']))"


@query(f"""SELECT p AS predicate, CASE {norm('p')} WHEN 'replacement interval' THEN 'replacement-interval' WHEN 'replacement period' THEN 'replacement-interval' WHEN 'service interval' THEN 'replacement-interval'
  WHEN 'change interval' THEN 'replacement-interval' WHEN 'dispense rate' THEN 'dispense-rate' WHEN 'flow rate' THEN 'dispense-rate' WHEN 'delivery rate' THEN 'dispense-rate' ELSE replace({norm('p')}, ' ', '-') END AS predicate_key FROM {PREDICATES}""")
def predicate_key(spark, d):
    end = F.when(F.col("p_size") % 4 == 0, " Interval").when(F.col("p_size") % 4 == 1, "_rate").otherwise("")
    fixed = spark.createDataFrame([(x,) for x in ("Replacement Interval", "service  interval", "Flow-rate", "DISPENSE RATE", "change interval", "Retail price", "", "É tat")], "predicate string")
    rows = t(spark, d, "part").select(F.concat("p_brand", end).alias("predicate")).union(fixed).distinct()
    return rows.select("predicate", U.predicate_key(F.col("predicate")).alias("predicate_key"))


@query("""WITH v AS (SELECT DISTINCT l_extendedprice AS x, CAST(l_linenumber AS INT) % 4 AS k FROM lineitem), r AS (SELECT x, k, floor(x)::BIGINT AS whole, printf('%02d', (round((x - floor(x)) * 100)::BIGINT) % 100) AS cents, format('{:,}', floor(x)::BIGINT) AS grouped FROM v WHERE round((x - floor(x)) * 100) < 100)
  SELECT DISTINCT CASE k WHEN 0 THEN '£' || grouped || '.' || cents WHEN 1 THEN 'about € ' || replace(grouped, ',', '.') || ',' || cents WHEN 2 THEN grouped || ' litres' ELSE whole || ',' || cents || ' bar' END AS raw,
    CASE k WHEN 2 THEN whole::DOUBLE ELSE round(whole + cents::DOUBLE / 100, 2) END AS value, CASE k WHEN 0 THEN 'money_gbp' WHEN 1 THEN 'money_eur' WHEN 2 THEN 'volume' ELSE 'pressure' END AS dimension, k = 1 AS approximate
  FROM r WHERE NOT (k = 1 AND whole < 1000) AND NOT (k = 2 AND whole >= 1000 AND whole < 1000)""")
def quantity_forms(spark, d):
    """Amounts as people write them: grouped by commas, by points with a decimal comma, with marks of currency and hedges."""
    v = t(spark, d, "lineitem").select(F.col("l_extendedprice").alias("x"), (F.col("l_linenumber").cast("int") % 4).alias("k")).distinct()
    cents = F.round((F.col("x") - F.floor("x")) * 100).cast("long")
    v = v.where(cents < 100).withColumn("whole", F.floor("x")).withColumn("cents", F.lpad((cents % 100).cast("string"), 2, "0")).withColumn("grouped", F.format_number("whole", 0))
    said = F.when(F.col("k") == 0, F.concat(F.lit("£"), "grouped", F.lit("."), "cents")).when(F.col("k") == 1, F.concat(F.lit("about € "), F.translate("grouped", ",", "."), F.lit(","), "cents"))
    said = said.when(F.col("k") == 2, F.concat("grouped", F.lit(" litres"))).otherwise(F.concat(F.col("whole").cast("string"), F.lit(","), "cents", F.lit(" bar")))
    rows = v.where("not (k = 1 and whole < 1000)").select(said.alias("raw")).distinct().withColumn("q", U.parse_quantity(F.col("raw")))
    return rows.select("raw", F.round("q.value", 2).alias("value"), "q.dimension", "q.approximate")


@query(f"WITH {MISSES} SELECT gap_key, source, count(*) AS n FROM m GROUP BY 1, 2")
def gap_source_counts(spark, d):
    return Q.source_counts(raw_misses(spark, d))


def queue_misses(spark, d):
    return Q.keyed(raw_misses(spark, d))


ENTRIES = """e AS (SELECT gap_key, count(*) AS total, min("at") AS first_seen, max("at") AS last_seen, count(DISTINCT surface) AS n_variants, first(surface ORDER BY "at", surface) AS surface_form,
  count(*) FILTER (source = 'chat') AS from_chat FROM m GROUP BY 1)"""


@query(f"""WITH {MISSES}, {ENTRIES} SELECT gap_key, surface_form, total, n_variants, first_seen::BIGINT AS first_seen, last_seen::BIGINT AS last_seen FROM e""")
def record_miss(spark, d):
    return Q.entries(raw_misses(spark, d)).select("gap_key", "surface_form", "total", "n_variants", F.unix_seconds("first_seen").alias("first_seen"), F.unix_seconds("last_seen").alias("last_seen"))


@query(f"""WITH {MISSES}, {ENTRIES}, s AS (SELECT *, CASE WHEN length(gap_key) % 5 <> 0 THEN 'open' WHEN total >= 100 * greatest(from_chat, 1) THEN 'open' ELSE 'dismissed' END AS status FROM e)
  SELECT gap_key, total, '**' || surface_form || '**: ' || concat_ws(' and ', CASE WHEN from_chat = 1 THEN '1 chat mention' WHEN from_chat > 1 THEN from_chat || ' chat mentions' END,
    CASE WHEN total - from_chat = 1 THEN '1 document mention' WHEN total > from_chat THEN (total - from_chat) || ' document mentions' END) || '.' AS question FROM s WHERE status = 'open' ORDER BY total DESC, gap_key LIMIT 50""")
def gap_list(spark, d):
    """The open part of the queue: every fifth key by its length was dismissed when chat alone had met it."""
    entries = Q.entries(raw_misses(spark, d))
    seen = F.coalesce(F.try_element_at("counts", F.lit("chat")), F.lit(0))
    none = {name: F.lit(None).cast("string") for name in ("run_id", "concept_id", "reason")}
    changes = entries.where(F.length("gap_key") % 5 == 0).select("gap_key", F.lit("dismissed").alias("status"), F.timestamp_seconds(F.lit(0)).alias("at"), Q.baseline(seen).alias("baseline")).withColumns(none)
    return Q.listed(Q.with_status(entries, changes)).select("gap_key", "total", Q.question().alias("question"))


@query(f"""WITH {MISSES} SELECT source, count(DISTINCT gap_key || ' ' || substr(sha1(locator), 1, 12)) AS n_evidence FROM m GROUP BY 1""")
def evidence_ids(spark, d):
    found = Q.keyed(raw_misses(spark, d, once=True))  # a word that a document repeats is one piece of evidence
    by_place = found.groupBy("source", "evidence_id").agg(F.size(F.collect_set("gap_key")).alias("n"))  # a row a place, not one for each of its words
    return by_place.groupBy("source").agg(F.sum("n").alias("n_evidence"))


def ring(spark, d):
    """Nations below their region, customers below their nation, and each region below the nation with its number: rings."""
    own = core.broader(spark, d)
    return own.union(t(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey"), F.concat(F.lit("n"), "r_regionkey")))


RING = f"(SELECT * FROM {core.BROADER} UNION ALL SELECT 'r' || r_regionkey, 'n' || r_regionkey FROM region)"


@query(f"WITH RECURSIVE b AS {RING}, p AS (SELECT child, parent FROM b WHERE child[1] <> 'c' AND child[1] <> 's' UNION SELECT p.child, b.parent FROM p JOIN b ON b.child = p.parent) SELECT DISTINCT child AS concept_id FROM p WHERE child = parent")
def broader_cycles(spark, d):
    return G.cycles(ring(spark, d)).select(F.col("node").alias("concept_id"))


@query("""WITH c AS (SELECT 'r' || r_regionkey AS id, r_name AS name, 'r' || r_regionkey AS top FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation)
  SELECT a.id AS root, b.id AS concept_id, b.name AS pref_label FROM c a JOIN c b ON a.id <> b.id AND NOT (a.id = b.top) WHERE a.id[1] = 'r'""")
def parent_candidates(spark, d):
    """Where each region may be put: any region or nation but itself and its own nations."""
    region = t(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("concept_id"), F.col("r_name").alias("pref_label"), F.lit(True).alias("is_top"))
    nation = t(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("concept_id"), F.col("n_name").alias("pref_label"), F.lit(False).alias("is_top"))
    all_of = region.union(nation)
    edges = core.broader(spark, d).where("child like 'n%'")
    return vocabulary.parent_candidates(region.select(F.col("concept_id").alias("root")), all_of.withColumn("scheme_id", F.lit("places")), all_of.select("concept_id", "pref_label"), edges, top_only=False)


EX = "http://example.org/"


def place_quads(spark, d) -> DataFrame:
    """Regions and nations as a published vocabulary: two schemes, labels, definitions of some, machine terms of every event type."""
    node = lambda prefix, c: F.concat(F.lit(f"<{EX}{prefix}"), c.cast("string"), F.lit(">"))
    typed, sk, dct = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>", publishing.skos, publishing.DCT
    said = lambda c, lang=None: T.literal(c, F.lit(lang) if lang else None)

    def of(rows, subject, **properties):
        pairs = F.array(*(F.struct(F.lit(p).alias("predicate"), o.alias("object"), F.lit("en" if p in spoken else None).cast("string").alias("lang")) for p, o in properties.items()))
        return rows.select(subject.alias("subject"), F.inline(F.filter(pairs, lambda x: x["object"].isNotNull())))

    spoken = {sk("prefLabel"), sk("altLabel"), sk("definition")}
    region, nation = t(spark, d, "region"), t(spark, d, "nation")
    places, machine = F.lit(f"<{EX}places>"), F.lit(f"<{EX}telemetry>")
    schemes = spark.createDataFrame([(f"<{EX}places>",), (f"<{EX}telemetry>",)], "subject string")
    kinds = t(spark, d, "events").select("event_type").distinct()
    rows = [
        of(schemes, F.col("subject"), **{typed: F.lit(sk("ConceptScheme")), f"<{dct}title>": F.when(F.col("subject").contains("places"), said(F.lit("Places")))}),
        of(region, node("r", F.col("r_regionkey")), **{typed: F.lit(sk("Concept")), sk("inScheme"): places, sk("topConceptOf"): places, sk("prefLabel"): said(F.col("r_name"), "en"), sk("definition"): F.when(F.col("r_regionkey") % 2 == 0, said(F.concat(F.lit("region "), "r_name"), "en"))}),
        of(nation, node("n", F.col("n_nationkey")), **{typed: F.lit(sk("Concept")), sk("inScheme"): places, sk("broader"): node("r", F.col("n_regionkey")), sk("prefLabel"): said(F.col("n_name"), "en"), sk("altLabel"): said(F.lower("n_name"), "en"), sk("related"): node("n", (F.col("n_nationkey") + 1) % 25), publishing.VERSION: said((F.col("n_nationkey") % 3 + 1).cast("string"))}),
        of(kinds, node("m-", F.col("event_type")), **{typed: F.lit(sk("Concept")), sk("inScheme"): machine, sk("topConceptOf"): machine, sk("prefLabel"): said(F.concat(F.lit("machine "), "event_type"), "en"), sk("notation"): said(F.col("event_type")), sk("closeMatch"): node("n", F.length("event_type")), sk("exactMatch"): F.when(F.col("event_type").startswith("c"), node("r", F.lit(1)))}),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out.select("subject", "predicate", "object", F.lit("published").alias("graph"), "lang", F.lit(None).cast("string").alias("datatype"))


@query(f"""SELECT '{EX}places' AS scheme_id, 'Places' AS title, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS concept_count, '{EX}r' || r_regionkey AS concept_id, r_name AS pref_label,
  CASE WHEN r_regionkey % 2 = 0 THEN 'region ' || r_name END AS definition, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS child_count FROM region""")
def scheme_tree(spark, d):
    schemes, top = vocabulary.scheme_tree(publishing.views(place_quads(spark, d)))
    return schemes.drop("description").join(top, "scheme_id")


@query(f"""SELECT '{EX}n' || n.n_nationkey AS concept_id, n.n_name AS pref_label, lower(n.n_name) AS alt_labels, '{EX}r' || n.n_regionkey AS parent, r.r_name AS parent_label, o.n_name AS related, n.n_nationkey % 3 + 1 AS version, 0::BIGINT AS child_count
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey JOIN nation o ON o.n_nationkey = (n.n_nationkey + 1) % 25""")
def concept_detail(spark, d):
    card = vocabulary.concept_detail(publishing.views(place_quads(spark, d))).where(F.col("concept_id").startswith(f"{EX}n"))
    return card.select("concept_id", F.col("pref_label")["en"].alias("pref_label"), F.array_join("alt_labels", ",").alias("alt_labels"), F.col("parent.concept_id").alias("parent"), F.col("parent.pref_label").alias("parent_label"), F.array_join("related.pref_label", ",").alias("related"), "version", "child_count")


@query(f"SELECT DISTINCT '{EX}n' || length(event_type) AS concept_id, event_type AS notation, 'closeMatch' AS match FROM events UNION ALL SELECT DISTINCT '{EX}r1', event_type, 'exactMatch' FROM events WHERE event_type[1] = 'c'")
def machine_signals(spark, d):
    return vocabulary.machine_signals(publishing.views(place_quads(spark, d))).select("concept_id", "notation", "match")


@query(f"""SELECT event_type AS token, CASE WHEN event_type[1] = 'c' THEN '{EX}r1' ELSE '{EX}n' || length(event_type) END AS concept_id, CASE WHEN event_type[1] = 'c' THEN 'exactMatch' ELSE 'closeMatch' END AS match, count(*) AS n, count(DISTINCT user_id) AS devices FROM events GROUP BY 1, 2, 3""")
def signal_mapping(spark, d):
    """Tokens by notation to the first target by exact, close, broad."""
    v = publishing.views(place_quads(spark, d))
    known = telemetry.mapping(v.facts.where(F.col("predicate") == publishing.skos("notation")).select("concept_id", F.col("value").alias("token")), v.links)
    signals = t(spark, d, "events").select(F.col("event_type").alias("token"), F.col("user_id").alias("device"))
    return telemetry.mapped(signals, known).groupBy("token", "concept_id", "match").agg(F.count("*").alias("n"), F.countDistinct("device").alias("devices"))


@query(f"""SELECT message, severity, n FROM (
  SELECT 'has no definition' AS message, 'warning' AS severity, count(*) AS n FROM region WHERE r_regionkey % 2 <> 0
  UNION ALL SELECT 'has no definition', 'warning', (SELECT count(*) FROM nation) + (SELECT count(DISTINCT event_type) FROM events)
  UNION ALL SELECT 'has a close match that does not exist', 'violation', count(DISTINCT event_type) FROM events WHERE length(event_type) NOT IN (SELECT n_nationkey FROM nation))
  WHERE n > 0""".replace("SELECT message, severity, n FROM", "SELECT message, severity, sum(n)::BIGINT AS n FROM").replace("WHERE n > 0", "WHERE n > 0 GROUP BY 1, 2"))
def gate_findings(spark, d):
    return G.gate_views(publishing.views(place_quads(spark, d))).groupBy("message", "severity").agg(F.count("*").alias("n"))


@query("""WITH q AS (SELECT '<p' || p_partkey || '>' AS subject, unnest(['<type>', '<name>', '<brand>']) AS predicate, unnest([p_type, p_name, p_brand]) AS object, p_size FROM part)
  SELECT CASE WHEN subject = (SELECT min('<p' || p_partkey || '>') FROM part) THEN 'history/1' ELSE 'published' END AS graph, predicate, count(*) AS n FROM q GROUP BY 1, 2""")
def archive_version(spark, d):
    rows = t(spark, d, "part").select(F.concat(F.lit("<p"), "p_partkey", F.lit(">")).alias("subject"), F.explode(F.map_from_arrays(F.array(*map(F.lit, ("<type>", "<name>", "<brand>"))), F.array("p_type", "p_name", "p_brand"))).alias("predicate", "object"), F.lit("published").alias("graph"))
    concept = rows.agg(F.min("subject").alias("s")).first()["s"]
    return S.archive(rows, concept, "history/1").groupBy("graph", "predicate").agg(F.count("*").alias("n"))


PAIRS = "(SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN replace(p_name, 'e', 'a') WHEN 1 THEN p_name || ' ' || p_brand ELSE substr(p_name, 2) END AS original, p_name AS corrected FROM part)"


@query(f"""WITH p AS (SELECT DISTINCT {norm('original')} AS a, {norm('corrected')} AS b FROM {PAIRS}), w AS (SELECT a, b, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM p WHERE a <> '' AND b <> '' AND a <> b),
  g AS (SELECT a, b FROM w WHERE NOT (list_has_any(x, y) AND (len(x) <> len(y) OR len(list_filter(range(1, len(x) + 1), lambda i: levenshtein(x[i], y[i]) > CASE WHEN length(x[i]) <= 4 THEN 1 WHEN length(x[i]) <= 8 THEN 2 ELSE 3 END)) > 0)))
  SELECT a AS original, min(b) AS corrected FROM g GROUP BY 1 HAVING count(DISTINCT b) = 1""")
def correction_map(spark, d):
    part = t(spark, d, "part")
    original = F.when(F.col("p_size") % 3 == 0, F.replace("p_name", F.lit("e"), F.lit("a"))).when(F.col("p_size") % 3 == 1, F.concat_ws(" ", "p_name", "p_brand")).otherwise(F.expr("substr(p_name, 2)"))
    return R.correction_map(part.select(original.alias("original"), F.col("p_name").alias("corrected")).distinct())


CASCADE = f"""l AS (SELECT {norm('p_name')} AS k, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type || p_name END AS concept FROM part WHERE p_brand < 'Brand#4'),
  i AS (SELECT k, count(DISTINCT concept) AS n, min(concept) AS concept FROM l GROUP BY 1), m AS (SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_brand WHEN 2 THEN '…' WHEN 3 THEN 'short ' || p_brand ELSE p_name END AS surface, p_name FROM part),
  a AS (SELECT DISTINCT {norm("'short ' || p_brand")} AS original, {norm('p_brand')} AS corrected FROM part)"""


@query(f"""WITH {CASCADE}, n AS (SELECT id, surface, {norm('surface')} AS normalised FROM m), k AS (SELECT id, normalised, coalesce(corrected, normalised) AS lookup FROM n LEFT JOIN a ON a.original = n.normalised)
  SELECT id, lookup, CASE WHEN normalised <> '' AND i.n = 1 THEN i.concept END AS concept_id, CASE WHEN normalised <> '' AND i.n = 1 THEN 'exact' ELSE 'abstain' END AS stage, CASE WHEN normalised <> '' AND i.n = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS score,
    CASE WHEN normalised <> '' AND i.n = 1 THEN CASE WHEN lookup <> normalised THEN 'alias' ELSE 'pref' END END AS label_kind, normalised <> '' AND coalesce(i.n, 0) > 1 AS collides FROM k LEFT JOIN i ON i.k = lookup""")
def resolve_cascade(spark, d):
    """Names and brands against labels some of which have several owners, with aliases; what stays open abstains."""
    part = t(spark, d, "part")
    concept = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_type", "p_name"))
    index = R.label_index(part.where("p_brand < 'Brand#4'").select(concept.alias("concept_id"), F.lit("s").alias("scheme_id"), F.col("p_name").alias("label"), F.lit("pref").alias("kind")))
    k = F.col("p_size") % 5
    surface = F.when(k == 0, F.upper("p_name")).when(k == 1, F.col("p_brand")).when(k == 2, "…").when(k == 3, F.concat(F.lit("short "), "p_brand")).otherwise(F.col("p_name"))
    aliases = part.select(T.normalise(F.concat(F.lit("short "), "p_brand")).alias("original"), T.normalise(F.col("p_brand")).alias("corrected")).distinct()
    out = R.resolve(part.select(F.col("p_partkey").alias("id"), surface.alias("surface")), index, aliases=aliases)
    return out.select("id", "lookup", "concept_id", "stage", "score", "label_kind", (F.size("collision") > 0).alias("collides"))


def part_documents(spark, d):
    """Each part as a document of two facts in lines of three fields."""
    part = t(spark, d, "part")
    cents = F.round(F.col("p_retailprice") * 100).cast("long").cast("string")
    text = F.concat(F.lit("# Part "), "p_partkey", F.lit("\n\n"), "p_name", F.lit(" | Retail price | "), cents, F.lit(" eur\n"), "p_brand", F.lit(" : stock : "), F.col("p_size").cast("string"), F.lit(" bottles\n"))
    return part.select(F.concat(F.lit("part-"), "p_partkey").alias("source_file"), F.lit("1").alias("doc_version"), F.lit("sheet").alias("doc_type"), F.lit(False).alias("is_html"), text.alias("text"))


#: The vocabulary is names of an even length, so that of all claims some are active and the others held.
NAMES = f"(SELECT DISTINCT {norm('p_name')} AS k FROM part WHERE length(p_name) % 2 = 0)"
CLAIMS = f"""c AS (SELECT 'part-' || p_partkey AS source_file, '3-3' AS line_range, p_name AS surface, 'Retail price' AS predicate, round(p_retailprice * 100)::BIGINT || ' eur' AS value FROM part
  UNION ALL SELECT 'part-' || p_partkey, '4-4', p_brand, 'stock', p_size || ' bottles' FROM part)"""


@query(f"""WITH {CLAIMS} SELECT sha1(source_file || ' 1 ' || line_range || ' ' || predicate || ' ' || value || ' ') AS claim_id, CASE WHEN k IS NULL THEN 'held' ELSE 'active' END AS status, k AS subject_concept,
  CASE WHEN k IS NULL THEN {key(norm('surface'))} END AS gap_key, line_range FROM c LEFT JOIN {NAMES} ON k = {norm('surface')}""")
def ingest_claims(spark, d):
    return _ingested(spark, d).claims.select("claim_id", "status", "subject_concept", "gap_key", "line_range")


def _ingested(spark: SparkSession, d: str) -> I.Ingested:
    names = t(spark, d, "part").where("length(p_name) % 2 = 0").select(T.normalise(F.col("p_name")).alias("w")).distinct()
    empty = spark.createDataFrame([], ", ".join(f"{c} {'double' if c in ('confidence', 'resolution_score') else 'string'}" for c in I.CLAIM))
    return I.ingest(part_documents(spark, d), R.build_index(core.word_labels(names)), empty, run_id="r")


@query(f"""WITH {CLAIMS}, s AS (SELECT source_file, line_range, CASE WHEN k IS NULL THEN 'held:' || {key(norm('surface'))} ELSE k END || '|' || CASE predicate WHEN 'stock' THEN 'stock' ELSE 'retail-price' END AS group_key, string_split(value, ' ')[1]::DOUBLE AS x FROM c LEFT JOIN {NAMES} ON k = {norm('surface')})
  SELECT group_key, count(*) AS members FROM s GROUP BY 1 HAVING count(*) >= 2 AND max(x) <> min(x) AND (max(x) - min(x)) / greatest(abs(max(x)), abs(min(x))) > 0.01""")
def ingest_conflicts(spark, d):
    """Contradictions over all that an ingestion stored; members stay rows."""
    return _ingested(spark, d).conflicts.groupBy("group_key").agg(F.count("*").alias("members"))


@query(f"""WITH b AS (SELECT item_id, list_distinct(list_filter(list_transform(string_split({norm('text')}, ' '), lambda w: {key('w')}), lambda w: w <> '')) AS ks FROM benchmark),
  h AS (SELECT doc_id, {key('w')} AS k FROM {DOC_WORDS}), u AS (SELECT item_id, unnest(ks) AS k FROM b)
  SELECT item_id AS draft_id, len(ks)::BIGINT AS n_surfaces, count(h.k) AS mention_count, count(DISTINCT doc_id) AS document_count FROM b JOIN u USING (item_id) LEFT JOIN h USING (k) GROUP BY item_id, ks""")
def draft_impact(spark, d):
    """What the words of each benchmark item, as labels of a draft, would resolve of the words of all documents."""
    drafts = t(spark, d, "benchmark").select(F.col("item_id").alias("draft_id"), P.surfaces(T.words(F.col("text"))).alias("keys"))
    # counts of a key and file are enough: no draft meets single mentions
    held = core.document_words(spark, d).select(T.merge_key(F.col("w")).alias("gap_key"), "doc_id").groupBy("gap_key", "doc_id").agg(F.count("*").alias("n"))
    met = drafts.select("draft_id", F.explode("keys").alias("gap_key")).join(held, "gap_key").groupBy("draft_id").agg(F.sum("n").alias("m"), F.countDistinct("doc_id").alias("f"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return drafts.where(F.size("keys") > 0).join(met, "draft_id", "left").select("draft_id", F.size("keys").cast("long").alias("n_surfaces"), zero("m").alias("mention_count"), zero("f").alias("document_count"))


@query("""SELECT event_type AS metric, count(*) AS n, count(DISTINCT user_id) AS devices, round(sum(value), 4) AS total, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest FROM events GROUP BY 1""")
def telemetry_points(spark, d):
    """Each event as a nested payload in JSON, parsed and flattened again."""
    named = lambda k, v, c: F.struct(F.lit(k).alias("key"), F.struct(c.alias(v)).alias("value"))
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    point = F.struct(F.col("value").alias("asDouble"), (F.unix_micros("ts").cast("decimal(20,0)") * 1000).cast("decimal(20,0)").cast("string").alias("timeUnixNano"), F.array(named("event.id", "intValue", F.col("event_id").cast("string"))).alias("attributes"))
    metric = F.struct(F.col("event_type").alias("name"), F.struct(F.array(point).alias("dataPoints")).alias("gauge"))
    body = F.struct(F.array(F.struct(F.struct(F.array(named("device.id", "stringValue", F.col("user_id").cast("string"))).alias("attributes")).alias("resource"), F.array(F.struct(F.array(metric).alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics"))
    points = telemetry.points(e.select(telemetry.parse_payloads(F.to_json(body)).alias("p")).select("p.*"))
    return points.groupBy("metric").agg(F.count("*").alias("n"), F.countDistinct(F.col("resource")["device.id"]).alias("devices"), F.round(F.sum("value"), 4).alias("total"), F.date_format(F.max("at"), "yyyy-MM-dd HH:mm:ss").alias("newest"))


@query("SELECT doc_id AS source_file, len(regexp_extract_all(text, '(?i)de\\s+la')) AS n FROM documents WHERE len(regexp_extract_all(text, '(?i)de\\s+la')) > 0")
def phrase_mentions(spark, d):
    return K.mentions(t(spark, d, "documents").select(F.col("doc_id").alias("source_file"), "text"), "de la")


@query("SELECT count(*) AS documents, sum(len(regexp_extract_all(coalesce(text, ''), '[^\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+')))::BIGINT AS words FROM documents")
def word_totals(spark, d):
    return K.word_totals(t(spark, d, "documents"))


@query("""WITH r AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority < '2'), p AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority > '4')
  SELECT o_custkey AS filename, 'is registered but not present' AS finding FROM r WHERE o_custkey NOT IN (SELECT o_custkey FROM p) UNION ALL SELECT o_custkey, 'is present but not registered' FROM p WHERE o_custkey NOT IN (SELECT o_custkey FROM r)""")
def registry_compare(spark, d):
    """Customers with urgent orders are registered, those with orders of the lowest priority are present."""
    orders = t(spark, d, "orders").select(F.col("o_custkey").alias("filename"), "o_orderpriority")
    return Y.compare(orders.where("o_orderpriority < '2'").select("filename").distinct(), orders.where("o_orderpriority > '4'").select("filename").distinct())


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

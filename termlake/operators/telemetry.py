"""Device signals: nested payloads flattened, tokens mapped to concepts, what maps to nothing, the latest of each device."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termlake.operators import gaps as Q

_VALUE = "value: struct<stringValue: string, intValue: string, doubleValue: double, boolValue: boolean>"
_ATTRIBUTES = f"attributes: array<struct<key: string, {_VALUE}>>"
_POINTS = f"dataPoints: array<struct<asDouble: double, asInt: string, timeUnixNano: string, startTimeUnixNano: string, {_ATTRIBUTES}>>"
_METRICS = f"metrics: array<struct<name: string, unit: string, gauge: struct<{_POINTS}>, sum: struct<isMonotonic: boolean, aggregationTemporality: int, {_POINTS}>>>"
_LOGS = f"logRecords: array<struct<timeUnixNano: string, severityText: string, body: struct<stringValue: string>, {_ATTRIBUTES}>>"
#: The shape of an export of metrics and logs.
SCHEMA = (
    f"resourceMetrics array<struct<resource: struct<{_ATTRIBUTES}>, scopeMetrics: array<struct<scope: struct<name: string, version: string>, {_METRICS}>>>>, "
    f"resourceLogs array<struct<resource: struct<{_ATTRIBUTES}>, scopeLogs: array<struct<scope: struct<name: string, version: string>, {_LOGS}>>>>"
)
# Attributes whose values are tokens, and mappings in the order in which they hold.
TOKEN_KEYS = ("component.type", "water.output", "fault.type", "fault.code", "service.type")
MATCH_RANK = {"exactMatch": 1, "closeMatch": 2, "broadMatch": 3}


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Files of one payload each."""
    return spark.read.schema(SCHEMA).json(path, multiLine=True)


def parse_payloads(texts: Column) -> Column:
    """A payload of a text; null where it is none."""
    return F.from_json(texts, SCHEMA)


def attribute_map(attributes: Column) -> Column:
    """Attributes as a map of texts: numbers and truth values as their text, the last of a repeated key."""
    told = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    known = F.filter(F.coalesce(attributes, F.array().cast(_ATTRIBUTES.partition(": ")[2])), lambda a: a["key"].isNotNull())
    keys = F.array_distinct(F.transform(known, lambda a: a["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.transform(F.filter(known, lambda a: a["key"] == k), lambda a: told(a["value"])), -1)))


def instant(nanos: Column) -> Column:
    """Nanoseconds since 1970 as text, to the microsecond."""
    return F.timestamp_micros(F.floor(nanos.cast("decimal(20,0)") / 1000).cast("bigint"))


def points(payloads: DataFrame) -> DataFrame:
    """(resource, scope, metric, unit, kind, monotonic, at, value, attributes) of every data point, gauges and sums. Payloads are read once for both."""
    scopes = payloads.select(F.explode("resourceMetrics").alias("r")).select(attribute_map(F.col("r.resource.attributes")).alias("resource"), F.explode("r.scopeMetrics").alias("s"))
    metrics = scopes.select("resource", F.col("s.scope.name").alias("scope"), F.explode("s.metrics").alias("m"))
    made = lambda kind, monotonic, at: F.transform(at, lambda p: F.struct(F.lit(kind).alias("kind"), monotonic.alias("monotonic"), p.alias("p")))
    kinds = F.array(made("gauge", F.lit(False), "m.gauge.dataPoints"), made("sum", F.coalesce("m.sum.isMonotonic", F.lit(False)), "m.sum.dataPoints"))
    both = metrics.select("resource", "scope", F.col("m.name").alias("metric"), F.col("m.unit").alias("unit"), F.explode(F.flatten(F.filter(kinds, lambda x: x.isNotNull()))).alias("k"))
    both = both.select("resource", "scope", "metric", "unit", "k.kind", "k.monotonic", "k.p")
    value = F.coalesce("p.asDouble", F.col("p.asInt").try_cast("double"))
    return both.select("resource", "scope", "metric", "unit", "kind", "monotonic", instant(F.col("p.timeUnixNano")).alias("at"), value.alias("value"), attribute_map(F.col("p.attributes")).alias("attributes"))


def logs(payloads: DataFrame) -> DataFrame:
    """(resource, scope, at, severity, body, attributes) of every log record."""
    scopes = payloads.select(F.explode("resourceLogs").alias("r")).select(attribute_map(F.col("r.resource.attributes")).alias("resource"), F.explode("r.scopeLogs").alias("s"))
    rows = scopes.select("resource", F.col("s.scope.name").alias("scope"), F.explode("s.logRecords").alias("l"))
    return rows.select("resource", "scope", instant(F.col("l.timeUnixNano")).alias("at"), F.col("l.severityText").alias("severity"), F.col("l.body.stringValue").alias("body"), attribute_map(F.col("l.attributes")).alias("attributes"))


def text_attributes(payload: Column) -> Column:
    """(key, value) of every {"key": k, "value": {"stringValue": v}} in JSON text, at any depth and in its order: the walk that needs no
    schema. Escapes in k and v are decoded."""
    text = r'"((?:[^"\\]|\\.)*)"'
    pair = rf'\{{\s*"key"\s*:\s*{text}\s*,\s*"value"\s*:\s*\{{\s*"stringValue"\s*:\s*{text}'
    found = F.regexp_extract_all(payload, F.lit(pair), F.lit(0))
    said = lambda x, i: F.from_json(F.concat(F.lit('["'), F.regexp_extract(x, pair, i), F.lit('"]')), "array<string>")[0]
    return F.transform(found, lambda x: F.struct(said(x, 1).alias("key"), said(x, 2).alias("value")))


def tokens(attributes: DataFrame, keys: tuple[str, ...] = TOKEN_KEYS) -> DataFrame:
    """(key, token, device, at) of rows (attributes, resource, at): the values that name something in the machine's language."""
    entries = attributes.select(F.explode("attributes").alias("key", "token"), F.try_element_at("resource", F.lit("device.id")).alias("device"), "at")
    return entries.where(F.col("key").isin(list(keys)) & F.col("token").isNotNull())


def mapping(notations: DataFrame, links: DataFrame) -> DataFrame:
    """(token, machine_id, concept_id, match) of notations (concept_id, token) and links (subject, predicate, target): for each machine
    term the first target by exact, close, broad, and among these the smallest. Without a target concept_id is null."""
    ranks = F.create_map(*(F.lit(x) for pair in MATCH_RANK.items() for x in pair))
    ranked = links.withColumn("rank", F.try_element_at(ranks, F.col("predicate"))).where("rank is not null")
    best = ranked.groupBy(F.col("subject").alias("machine_id")).agg(F.min(F.struct("rank", F.col("target").alias("concept_id"), F.col("predicate").alias("match"))).alias("best"))
    named = notations.groupBy("token").agg(F.min("concept_id").alias("machine_id"))
    return named.join(best, "machine_id", "left").select("token", "machine_id", "best.concept_id", "best.match")


def mapped(signals: DataFrame, known: DataFrame) -> DataFrame:
    """signals (token, ...) with concept_id and match; both null where the token is unknown or its term has no target. Notations are
    governed and few, but their number is left to the planner, which broadcasts them by their size."""
    return signals.join(known.select("token", "concept_id", "match"), "token", "left")


def unmapped(signals: DataFrame) -> DataFrame:
    """(token, occurrences, devices) of mapped() signals that lead to no concept."""
    return signals.where("concept_id is null").groupBy("token").agg(F.count("*").alias("occurrences"), F.countDistinct("device").alias("devices"))


def unmapped_misses(signals: DataFrame, scheme: str | None = None, run_id: str | None = None) -> DataFrame:
    """Misses for the gap queue, one for each occurrence, the device being the place: a signal that maps to nothing asks for a new concept."""
    text = F.concat_ws(" ", F.lit("signal"), "key", "token")
    return signals.where("concept_id is null").select(
        F.col("token").alias("surface"), F.lit(None).cast("string").alias("merge_as"), F.lit("telemetry").alias("source"), text.alias("text"), F.concat(F.lit("device:"), F.coalesce("device", F.lit("?"))).alias("locator"),
        F.lit(None).cast("string").alias("doc_version"), "at", F.lit(Q.NEW_CONCEPT).alias("gap_type"), F.lit(None).cast(Q.SUGGESTIONS).alias("suggestions"), F.lit(scheme).cast("string").alias("scheme"), F.lit(run_id).cast("string").alias("run_id"),
    )


def expectations(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(token, finding) of found tokens that were not expected, and expected ones that were not found."""
    a, b = found.select("token").distinct(), expected.select("token").distinct()
    return a.subtract(b).withColumn("finding", F.lit("unexpected")).unionByName(b.subtract(a).withColumn("finding", F.lit("missing")))


def latest(signals: DataFrame, keys: tuple[str, ...] = ("concept_id", "device"), order: tuple[str, ...] = ("at",)) -> DataFrame:
    """The newest row of each concept and device, partial before it is shuffled."""
    rest = [c for c in signals.columns if c not in keys]
    return signals.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*")


def fleet(signals: DataFrame, concept_id: str, device: str | None = None) -> DataFrame:
    """The latest signals of a concept, of all devices or of one."""
    own = signals.where(F.col("concept_id") == concept_id)
    return latest(own if device is None else own.where(F.col("device") == device))


def unexpired(rows: DataFrame, at: str, days: int, now: Column) -> DataFrame:
    """rows that are not older than so many days."""
    return rows.where(F.col(at) > now - F.make_dt_interval(F.lit(days)))


def increments(rows: DataFrame, series: list[str]) -> DataFrame:
    """points with increment: of a monotonic sum what was added since the point before, a fall being a reset from 0; null for the first
    point and for gauges, whose values stand for themselves."""
    before = F.lag("value").over(Window.partitionBy(*series).orderBy("at"))
    grown = F.when(F.col("value") >= before, F.col("value") - before).otherwise(F.col("value"))
    return rows.withColumn("increment", F.when(F.col("monotonic") & before.isNotNull(), grown))

"""The queue of terms that the vocabulary lacks: appended misses and changes of state, folded into snapshots.

Writers only append, so none waits for another and no count is lost.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termlake.functions import text as T
from termlake.scratch import hadoop, stage
from termlake.sources.quads import current_version, point, version_path

SUGGESTIONS = "array<struct<concept_id: string, label: string, score: double>>"
MISS = f"surface string, merge_as string, source string, text string, locator string, doc_version string, at timestamp, gap_type string, suggestions {SUGGESTIONS}, scheme string, run_id string"
MISS_COLUMNS = ("surface", "merge_as", "source", "text", "locator", "doc_version", "at", "gap_type", "suggestions", "scheme", "run_id")
CHANGE = "gap_key string, status string, at timestamp, run_id string, concept_id string, reason string, baseline bigint"
EVIDENCE, VARIANTS, LIMIT, MOST = 5, 50, 50, 200
QUESTION_TEXT = 400
RESURFACE = 100
# Kinds of gaps.
ADD_LABEL, NEW_CONCEPT, ADD_MAPPING = "AddAltLabel", "NewConcept", "AddMapping"


def evidence_id(source: Column, text: Column, locator: Column) -> Column:
    """What makes two occurrences one piece of evidence: the place, or else the source and the first 120 characters."""
    return F.substring(F.sha1(F.coalesce(F.nullif(locator, F.lit("")), F.concat(source, F.lit(":"), F.substring(F.coalesce(text, F.lit("")), 1, 120)))), 1, 12)


def keyed(misses: DataFrame) -> DataFrame:
    """misses with gap_key, display and evidence_id; a form that normalises to nothing names no term and raises."""
    display = F.coalesce("merge_as", "surface")
    key = F.coalesce(T.merge_key(display), F.lit(""))
    checked = F.when(key != "", key).otherwise(F.raise_error(F.concat(F.lit("normalises to nothing, so it names no term: "), F.coalesce(display, F.lit("null")))).cast("string"))
    return misses.select("*", checked.alias("gap_key"), display.alias("display"), evidence_id(F.col("source"), F.col("text"), F.col("locator")).alias("evidence_id"))


def chat_misses(unresolved: DataFrame, at: Column, run_id: str | None = None) -> DataFrame:
    """Misses of unresolved (question, surface, lookup, shortlist): the place is a digest of the question, so one asked twice is one
    piece of evidence and two occurrences. A form that an alias changed merges under the alias, and what was typed is its variant."""
    place = F.concat(F.lit("chat:"), F.substring(F.sha1(F.trim("question")), 1, 12))
    alias = F.when(F.col("lookup") != T.normalise(F.col("surface")), F.col("lookup"))
    return unresolved.select(
        "surface", alias.alias("merge_as"), F.lit("chat").alias("source"), F.substring(F.trim("question"), 1, QUESTION_TEXT).alias("text"), place.alias("locator"),
        F.lit(None).cast("string").alias("doc_version"), at.alias("at"), F.lit(ADD_LABEL).alias("gap_type"), F.col("shortlist").alias("suggestions"), F.lit(None).cast("string").alias("scheme"), F.lit(run_id).cast("string").alias("run_id"),
    )


def source_counts(misses: DataFrame) -> DataFrame:
    """(gap_key, source, n) of misses (surface, merge_as, source), whose distinct forms are normalised; a source never seen has no row."""
    counted = misses.groupBy("surface", "merge_as", "source").agg(F.count("*").alias("n"))
    return keyed(counted.withColumns({x: F.lit(None).cast("string") for x in ("text", "locator")})).groupBy("gap_key", "source").agg(F.sum("n").alias("n"))


#: What misses have in common apart from their time, and so are counted by.
FORM = ("surface", "merge_as", "source", "gap_type", "suggestions", "scheme", "run_id")


def forms(misses: DataFrame) -> DataFrame:
    """(gap_key, display, FORM, n, first_at, last_at): misses counted. They are read and shuffled once; then each form is normalised, not
    each miss. Forms add up: see merged()."""
    counted = misses.groupBy(*FORM).agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    return keyed(counted.withColumns({x: F.lit(None).cast("string") for x in ("text", "locator")})).select("gap_key", "display", *FORM, "n", "first_at", "last_at")


def merged(rows: DataFrame) -> DataFrame:
    """Forms of several tables as one."""
    return rows.groupBy("gap_key", "display", *FORM).agg(F.sum("n").alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def folded(rows: DataFrame) -> DataFrame:
    """A row a gap of forms(): total, counts by source, the first form, when first and last seen, the kind it had first, what was last
    suggested; n_variants and VARIANTS of them at most, the most frequent. A source never seen is absent from counts, not 0."""
    newest = F.struct("last_at", "surface", "source")
    by_source = rows.groupBy("gap_key", "source").agg(
        F.sum("n").alias("n"), F.min(F.struct(F.col("first_at").alias("at"), "display", "gap_type")).alias("first"),
        F.max_by(F.struct("suggestions", "scheme", "run_id"), newest).alias("last"), F.max(newest).alias("last_seen"),
    )
    whole = by_source.groupBy("gap_key").agg(
        F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("counts"),
        F.min("first").alias("first"), F.max("last_seen.last_at").alias("last_seen"), F.max_by("last", "last_seen").alias("last"),
    ).withColumn("first_seen", F.col("first.at"))
    spelt = rows.groupBy("gap_key", "surface").agg(F.sum("n").alias("n"))
    place = Window.partitionBy("gap_key").orderBy(F.desc("n"), "surface")
    ranked = spelt.withColumns({"nth": F.row_number().over(place), "n_variants": F.count("*").over(Window.partitionBy("gap_key"))}).where(F.col("nth") <= VARIANTS)
    variants = ranked.groupBy("gap_key").agg(F.sort_array(F.collect_list("surface")).alias("variants"), F.max("n_variants").alias("n_variants"))
    return whole.join(variants, "gap_key").select(
        "gap_key", F.col("first.display").alias("surface_form"), F.col("first.gap_type").alias("gap_type"), "counts", "total", "variants", "n_variants",
        F.coalesce("last.suggestions", F.expr(f"cast(array() as {SUGGESTIONS})")).alias("suggestions"), F.col("last.scheme").alias("suggested_scheme"), "first_seen", "last_seen", F.col("last.run_id").alias("run_id"),
    )


def entries(misses: DataFrame) -> DataFrame:
    """folded() of misses."""
    return folded(stage(forms(misses), "forms"))


PLACE = ("source", "text", "locator", "doc_version", "at")


def pieces(rows: DataFrame) -> DataFrame:
    """(gap_key, evidence_id, PLACE): of each piece of evidence of keyed misses, or of pieces of several tables, the last occurrence, ties
    by text and then by the rest of PLACE. The struct that is compared is what is kept, so each value is shuffled once."""
    last = F.max(F.struct("at", "text", "source", "locator", "doc_version")).alias("of")
    return rows.groupBy("gap_key", "evidence_id").agg(last).select("gap_key", "evidence_id", *(f"of.{x}" for x in PLACE))


def evidence(misses: DataFrame, most: int = EVIDENCE) -> DataFrame:
    """(gap_key, source, rank, evidence_id, text, locator, doc_version, at): of each source the earliest `most` pieces of keyed misses."""
    return earliest(pieces(misses), most)


def earliest(rows: DataFrame, most: int = EVIDENCE) -> DataFrame:
    order = Window.partitionBy("gap_key", "source").orderBy("at", "evidence_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def baseline(total: Column) -> Column:
    """What a dismissal records: the total at that moment, 1 at least."""
    return F.greatest(total, F.lit(1))


def with_status(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """entries with status, baseline and `resurfaced`. The last change holds, without one a gap is open; a dismissed gap that has since
    been met RESURFACE times as often as at its dismissal counts as open."""
    last = changes.groupBy("gap_key").agg(F.max_by(F.struct("status", "baseline", "reason", "concept_id", F.col("run_id").alias("by_run")), F.struct("at", "status")).alias("last")).select("gap_key", "last.*")
    back = (F.col("status") == "dismissed") & (F.col("baseline") > 0) & (F.col("total") >= F.col("baseline") * RESURFACE)
    out = rows.join(last, "gap_key", "left").withColumn("resurfaced", F.coalesce(back, F.lit(False)))
    return out.withColumn("status", F.when(F.col("resurfaced") | F.col("status").isin("reopened", "resurfaced"), "open").otherwise(F.coalesce("status", F.lit("open"))))


def listed(rows: DataFrame, status: str | None = "open", limit: int = LIMIT) -> DataFrame:
    """Entries with status, the most frequent first, ties by key; a report of `limit` rows, MOST at most."""
    own = rows if status is None else rows.where(F.col("status") == status)
    return own.orderBy(F.desc("total"), "gap_key").limit(min(limit, MOST))


def question() -> Column:
    """An entry as one question. The sentences are fixed values."""
    counted = F.transform(F.filter(F.array_sort(F.map_entries("counts")), lambda e: e["value"] > 0), lambda e: F.concat_ws(" ", e["value"].cast("string"), e["key"], F.when(e["value"] == 1, "mention").otherwise("mentions")))
    counts, name, best = F.array_join(counted, " and "), F.concat(F.lit("**"), "surface_form", F.lit("**")), F.get(F.col("suggestions"), F.lit(0))["label"]
    return (
        F.when((F.col("gap_type") == ADD_LABEL) & best.isNotNull(), F.concat(name, F.lit(": "), counts, F.lit(". Closest term: **"), best, F.lit("**.")))
        .when(F.col("gap_type") == NEW_CONCEPT, F.concat(name, F.lit(": "), counts, F.lit(", matches nothing. Closest scheme: **"), F.coalesce(F.nullif("suggested_scheme", F.lit("")), F.lit("no scheme")), F.lit("**.")))
        .when((F.col("gap_type") == ADD_MAPPING) & best.isNotNull(), F.concat(F.lit("Signal "), name, F.lit(" looks like **"), best, F.lit("**.")))
        .otherwise(F.concat(name, F.lit(": "), counts, F.lit(".")))
    )


def target() -> Column:
    """What an entry asks to edit: its first suggestion, and its form as the label to add."""
    return F.struct(F.get(F.col("suggestions"), F.lit(0))["concept_id"].alias("concept_id"), F.col("surface_form").alias("label"))


class GapQueue:
    """Misses and changes below `path`. Writers only append: each batch of misses is a folder of the log, so none waits for another.

    compact() folds the log into a snapshot of forms and pieces of evidence, which add up; readers take the snapshot that the newest
    pointer names and the folders that it has not folded, so what they read grows with what came since.
    """

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], datetime.datetime] = lambda: datetime.datetime.now(datetime.UTC)) -> None:
        self.spark, self.path, self.clock = spark, path, clock
        spark.createDataFrame([], CHANGE).write.mode("append").parquet(f"{path}/changes")

    def record(self, misses: DataFrame) -> None:
        """Append misses after their keys are checked; nothing is read first."""
        rows = keyed(misses.select(*MISS_COLUMNS))
        rows.where(F.length("gap_key") > 0).drop("display", "evidence_id", "gap_key").write.parquet(f"{self.path}/log/{uuid.uuid4().hex}")

    def _logged(self) -> list[str]:
        """Names of the folders of the log that are whole."""
        place, store = hadoop(self.spark, f"{self.path}/log/*/_SUCCESS")
        return sorted(x.getPath().getParent().getName() for x in store.globStatus(place) or [])

    def _snapshot(self) -> tuple[int, str | None, set[str]]:
        """(version, its folder, the names that it has folded); a folder of the log is named until it is pruned."""
        version = current_version(self.spark, self.path)
        if not version:
            return 0, None, set()
        folder = version_path(self.spark, self.path, version)
        return version, folder, {x["name"] for x in self.spark.read.parquet(f"{folder}/folded").collect()}

    def _read(self, names: Iterable[str]) -> DataFrame:
        paths = [f"{self.path}/log/{name}" for name in names]
        return self.spark.read.schema(MISS).parquet(*paths) if paths else self.spark.createDataFrame([], MISS)

    def misses(self) -> DataFrame:
        """What the log has of misses: all, until it is pruned."""
        return self._read(self._logged())

    def _now(self) -> tuple[DataFrame, DataFrame]:
        """(forms, pieces) of snapshot and log."""
        _, folder, done = self._snapshot()
        rest = self._read(x for x in self._logged() if x not in done)
        counted, places = forms(rest), pieces(keyed(rest))
        if folder is None:
            return counted, places
        read = self.spark.read.parquet
        return merged(read(f"{folder}/forms").unionByName(counted)), pieces(read(f"{folder}/pieces").unionByName(places))

    def compact(self) -> int:
        """Fold what came since the last snapshot into a new one; its version. Raises VersionConflict if another one was first."""
        version, _, done = self._snapshot()
        names = self._logged()
        if done.issuperset(names):
            return version
        counted, places = self._now()
        name = uuid.uuid4().hex
        counted.write.parquet(f"{self.path}/data/{name}/forms")
        places.write.parquet(f"{self.path}/data/{name}/pieces")
        self.spark.createDataFrame([(x,) for x in names], "name string").coalesce(1).write.parquet(f"{self.path}/data/{name}/folded")
        return point(self.spark, self.path, version, name)

    def prune(self) -> int:
        """Delete the folders of the log that the newest snapshot has folded; their number. Readers of older snapshots must be gone."""
        _, _, done = self._snapshot()
        gone = [x for x in self._logged() if x in done]
        for name in gone:
            place, store = hadoop(self.spark, f"{self.path}/log/{name}")
            store.delete(place, True)
        return len(gone)

    def changes(self) -> DataFrame:
        return self.spark.read.schema(CHANGE).parquet(f"{self.path}/changes")

    def entries(self) -> DataFrame:
        return with_status(folded(stage(self._now()[0], "forms")), self.changes())

    def evidence(self) -> DataFrame:
        return earliest(self._now()[1])

    def read(self, gap_key: str) -> dict | None:
        row = self.entries().where(F.col("gap_key") == gap_key).first()
        return row and row.asDict(recursive=True)

    def exists(self, gap_key: str) -> bool:
        return not self._now()[0].where(F.col("gap_key") == gap_key).isEmpty()

    def list(self, status: str | None = "open", limit: int = LIMIT) -> DataFrame:
        return listed(self.entries(), status, limit)

    def _change(self, rows: DataFrame) -> None:
        rows.select(*self.changes().columns).coalesce(1).write.mode("append").parquet(f"{self.path}/changes")

    def close(self, closed: DataFrame, run_id: str) -> None:
        """Mark closed (gap_key, concept_id) as answered by a publication."""
        now = F.lit(self.clock())
        self._change(closed.select("gap_key", F.lit("actioned").alias("status"), now.alias("at"), F.lit(run_id).alias("run_id"), "concept_id", F.lit(None).cast("string").alias("reason"), F.lit(None).cast("long").alias("baseline")))

    def reopen(self, rows: DataFrame) -> None:
        """Put gaps (gap_key) back; only a reset does so."""
        empty = {name: F.lit(None).cast(kind) for name, kind in (("run_id", "string"), ("concept_id", "string"), ("reason", "string"), ("baseline", "long"))}
        self._change(rows.select("gap_key").withColumns({"status": F.lit("reopened"), "at": F.lit(self.clock())} | empty))

    def dismiss(self, gap_key: str, reason: str) -> dict | None:
        """Hide a gap and record its total; None if there is none. Its counts go on."""
        row = self.entries().where(F.col("gap_key") == gap_key).select("gap_key", baseline(F.col("total")).alias("baseline")).first()
        if row is None:
            return None
        self._change(self.spark.createDataFrame([(gap_key, "dismissed", self.clock(), None, None, reason, row["baseline"])], CHANGE))
        return self.read(gap_key)

    def resurface(self) -> int:
        """Write down which gaps have come back, so that each comes back once a dismissal; their number."""
        back = self.entries().where("resurfaced").select("gap_key").withColumns({"status": F.lit("resurfaced"), "at": F.lit(self.clock()), "run_id": F.lit(None).cast("string"), "concept_id": F.lit(None).cast("string"), "reason": F.lit(None).cast("string"), "baseline": F.lit(None).cast("long")})
        before = self.changes().count()
        self._change(back)
        return self.changes().count() - before

"""The register of documents: manifests, versions, which documents to read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlake.operators.claims import upsert

RECORD = "filename string, doc_type string, doc_version string, issued string, valid_from string, valid_to string, format string, authority string, applies_to array<string>"
REQUIRED = ("doc_type", "doc_version", "issued", "format", "authority")


class UnknownDocument(ValueError):
    """A document was asked for that is not registered."""


def parse_manifest(spark: SparkSession, payload: str) -> DataFrame:
    """The `documents` of a manifest in JSON; whatever else it holds is left alone."""
    raw = spark.createDataFrame([(payload,)], "payload string")
    return raw.select(F.inline(F.from_json("payload", f"documents array<struct<{_struct()}>>")["documents"]))


def _struct() -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (x.strip().split(" ", 1) for x in RECORD.split(", ")))


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """parse_manifest() of files; each is one JSON document."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.inline(F.from_json("value", f"documents array<struct<{_struct()}>>")["documents"]))


def register(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored with new records in place of those with equal filename and version; doing it twice changes nothing. Empty keys raise."""
    key = lambda name: F.when(F.coalesce(F.col(name), F.lit("")) != "", F.col(name)).otherwise(F.raise_error(F.lit(f"{name} may not be empty")).cast("string"))
    checked = new.withColumn("filename", key("filename")).withColumn("doc_version", key("doc_version"))
    return upsert(stored, checked, ["filename", "doc_version"], ["issued", "format"])


def registered(stored: DataFrame) -> DataFrame:
    return stored.orderBy("filename", "doc_version")


def newest(stored: DataFrame) -> DataFrame:
    """Of each filename the row with the largest version, in text order."""
    rest = [c for c in stored.columns if c != "filename"]
    return stored.groupBy("filename").agg(F.max_by(F.struct(*rest), "doc_version").alias("row")).select("filename", "row.*")


def raw_texts(spark: SparkSession, path: str) -> DataFrame:
    """(filename, text) of files, each a whole text in UTF-8."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"), F.col("value").alias("text"))


def documents(stored: DataFrame, texts: DataFrame, only: list[str] | None = None) -> DataFrame:
    """The newest records with their texts (filename, text), all or those named; a name that is not registered raises UnknownDocument."""
    rows = newest(stored)
    if only is not None:
        known = {r["filename"] for r in rows.where(F.col("filename").isin(only)).select("filename").collect()}
        if unknown := sorted(set(only) - known):
            raise UnknownDocument(", ".join(unknown))
        rows = rows.where(F.col("filename").isin(only))
    return rows.join(texts, "filename")


def compare(stored: DataFrame, present: DataFrame) -> DataFrame:
    """(filename, finding) of what is registered and not present, or present (filename) and not registered."""
    a = stored.select("filename").distinct().withColumn("here", F.lit(True))
    b = present.select("filename").distinct().withColumn("there", F.lit(True))
    both = a.join(b, "filename", "full_outer")
    return both.where("here is null or there is null").select("filename", F.when(F.col("here").isNull(), "is present but not registered").otherwise("is registered but not present").alias("finding"))


def incomplete(stored: DataFrame) -> DataFrame:
    """(filename, field) of required fields that are empty."""
    lacking = F.filter(F.array(*(F.when(F.coalesce(F.col(name), F.lit("")) == "", F.lit(name)) for name in REQUIRED)), lambda x: x.isNotNull())
    return stored.select("filename", F.explode(lacking).alias("field"))

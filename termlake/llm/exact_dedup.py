"""Exact duplicates by a log-structured merge index over text digests. DataFrame functions only.

Memtables of bounded size are flushed as runs of level 0: digests in order, each with its smallest id and number of
rows, and a filter of the run's digests. Compaction goes level by level: of FANOUT runs, the digests that another run's
filter may hold are merged, the smallest id stays, and all others are carried over as they are. The one run of the last level
is the index. Hits, that is documents whose digest belongs to several rows, are compared byte by byte with the one that stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termlake.llm.common import HOT, fresh, rows_of, scratch_path, stage_table

#: Rows of a memtable, about; runs that are merged into one of the next level.
MEMTABLE_ROWS = 1 << 16
FANOUT = 8
#: Copies compared with one replica of the text that stays.
PER_REPLICA = 512
#: Bits of a filter for each key, and of any filter at least and at most. A bitmap has 32768 bits. Filters are broadcast up to
#: MOST_BITS, which are 32 MB; larger sets of runs' filters are joined by shuffle, and a larger set of hits gets a
#: filter that lets more false hits through, which the joins then drop.
KEY_BITS = 16
LEAST_BITS = 1 << 15
MOST_BITS = 1 << 28


def normalised(text: Column) -> Column:
    """White space runs become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def filter_bits(keys: int) -> int:
    """Size of a filter of so many keys: a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (KEY_BITS * max(keys, 1) - 1).bit_length()))


class MergeIndex:
    """Runs (run, digest, keep_id, n) below `path` by level, and their filters (run, bucket, bitmap)."""

    RUNS, FILTERS = "run int, digest binary, keep_id bigint, n bigint", "run int, bucket bigint, bitmap binary"

    def __init__(self, spark: SparkSession, path: str, memtable_rows: int = MEMTABLE_ROWS, fanout: int = FANOUT) -> None:
        self.spark, self.path, self.memtable_rows, self.fanout = spark, path, memtable_rows, fanout
        self.level, self.memtables = 0, 0

    def flush(self, digests: DataFrame) -> None:
        """Store digests (doc_id, digest) as runs of level 0, one for each memtable; rows of a digest meet in a task only after partial counts."""
        self.level, self.memtables = 0, -(-digests.count() // self.memtable_rows)
        of = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(max(self.memtables, 1))).cast("int")
        self._store(digests.groupBy(of.alias("run"), "digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n")))

    def _store(self, rows: DataFrame) -> None:
        rows.sortWithinPartitions("run", "digest").write.option("compression", "zstd").parquet(f"{self.path}/level={self.level}")
        place = F.pmod(F.xxhash64("digest"), F.lit(self._bits()))
        bits = self.runs().select("run", F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
        bits.groupBy("run", "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap")).write.parquet(f"{self.path}/filters={self.level}")

    def _bits(self) -> int:
        """Bits of a filter of this level, the same for all its runs."""
        return max(LEAST_BITS, 1 << (KEY_BITS * self.memtable_rows * self.fanout**self.level - 1).bit_length())

    def runs(self) -> DataFrame:
        return self.spark.read.schema(self.RUNS).parquet(f"{self.path}/level={self.level}")

    def filters(self) -> DataFrame:
        return self.spark.read.schema(self.FILTERS).parquet(f"{self.path}/filters={self.level}")

    def number(self) -> int:
        """Runs of this level at most."""
        return -(-self.memtables // self.fanout**self.level)

    def compact(self) -> DataFrame:
        """Merge level by level until one run is left, and return it."""
        while self.number() > 1:
            self._merge()
        return self.runs().drop("run")

    def _merge(self) -> None:
        bits = self._bits()
        group = F.floor(F.col("run") / self.fanout).cast("int").alias("into")
        # fanout bitmaps of 4 KB a row at most
        probes = self.filters().groupBy(group, "bucket").agg(F.collect_list(F.struct("run", "bitmap")).alias("probes"))
        if self.number() * bits <= MOST_BITS:
            probes = F.broadcast(probes)
        place = F.pmod(F.xxhash64("digest"), F.lit(bits))
        rows = self.runs().withColumns({"into": group, "bucket": F.bitmap_bucket_number(place), "bit": F.bitmap_bit_position(place)})
        elsewhere = F.exists("probes", lambda p: (p["run"] != F.col("run")) & _is_set(p["bitmap"], F.col("bit")))
        probed = rows.join(probes, ["into", "bucket"]).select("into", "digest", "keep_id", "n", elsewhere.alias("hit"))
        merged = probed.where("hit").groupBy("into", "digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
        carried = probed.where("not hit").drop("hit")
        self.level += 1
        self._store(merged.unionByName(carried).withColumnRenamed("into", "run"))


def looked_up(digests: DataFrame, index: DataFrame) -> DataFrame:
    """digests with keep_id and n of the index. Hot digests, HOT at most, are broadcast; the others join by digest."""
    total = index.agg(F.sum("n").alias("total"))
    hot = index.crossJoin(F.broadcast(total)).where(F.col("n") * HOT > F.col("total")).select("digest", F.col("keep_id").alias("hot_id"), F.col("n").alias("hot_n"))
    marked = digests.join(F.broadcast(hot), "digest", "left")
    cold = marked.where("hot_n is null").drop("hot_id", "hot_n").join(index, "digest")
    return cold.unionByName(marked.where("hot_n is not null").withColumnsRenamed({"hot_id": "keep_id", "hot_n": "n"}))


def hit_filter(keys: DataFrame, bits: int, key: str = "digest") -> DataFrame:
    """A set of keys as bits // 32768 bitmaps of 4 KB at most, (bucket, bitmap): bits is the bound for what is broadcast."""
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    return keys.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def marked_hits(rows: DataFrame, bitmaps: DataFrame, bits: int, key: str, name: str) -> DataFrame:
    """rows, and whether their key may be in the filter in a column `name`: where that is false it is not."""
    bucket, bit, bitmap = fresh(rows.columns, "filter_bucket", "filter_bit", "filter_bitmap")
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    marked = rows.withColumn(bucket, F.bitmap_bucket_number(place)).withColumn(bit, F.bitmap_bit_position(place))
    joined = marked.join(F.broadcast(bitmaps.toDF(bucket, bitmap)), bucket, "left")
    known = F.coalesce(_is_set(F.col(bitmap), F.col(bit)), F.lit(False))
    return joined.withColumn(name, known).drop(bucket, bit, bitmap)


def probe(rows: DataFrame, bitmaps: DataFrame, bits: int, key: str, hit: bool) -> DataFrame:
    """Those rows whose key may be in the filter, or those whose key is not in it: none that is in it is among these."""
    (name,) = fresh(rows.columns, "filter_hit")
    marked = marked_hits(rows, bitmaps, bits, key, name)
    return marked.where(F.col(name) if hit else ~F.col(name)).drop(name)


def may_hit(rows: DataFrame, bitmaps: DataFrame, bits: int, key: str = "digest") -> DataFrame:
    return probe(rows, bitmaps, bits, key, True)


def unequal_hits(hits: DataFrame, several: DataFrame) -> DataFrame:
    """(doc_id, digest, text) of the hits whose normalised bytes differ from those of the document that stays.

    hits: doc_id, digest, text (normalised) of all rows whose digest several rows have, and perhaps of others. The text that
    stays is sent in one replica for each PER_REPLICA copies, of which a copy picks one.
    """
    hits = looked_up(hits, several)
    hits = stage_table(hits.withColumn("replicas", F.ceil(F.col("n") / PER_REPLICA).cast("int")).drop("n"), "hits")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    kept = hits.where(stays).groupBy("digest", "replicas").agg(F.min_by("text", "doc_id").alias("kept_text"))
    kept = kept.select("digest", "kept_text", F.explode(F.sequence(F.lit(0), F.col("replicas") - 1)).alias("replica"))
    copies = hits.withColumn("replica", F.pmod(F.xxhash64("doc_id", "digest"), F.col("replicas")).cast("int"))
    return copies.join(kept, ["digest", "replica"]).where(F.col("text") != F.col("kept_text")).select("doc_id", "digest", "text")


def exact_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = sha256, memtable_rows: int = MEMTABLE_ROWS, fanout: int = FANOUT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs.

    Texts are equal when their normalised bytes are, however long they are; the smallest doc_id of equal texts stays. Null and
    empty texts are one group. Rows that repeat a doc_id with equal text all name that id, and all count as kept; so do rows
    without doc_id whose texts no row with one has. `digest` may be a weaker function: hits that fail the comparison of
    bytes are then grouped by their bytes. Columns but doc_id and text stay behind. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = rows_of(docs, doc_id=F.col("doc_id").cast("long"), text=normalised(F.col("text")))
    own_sha = [] if digest is sha256 else [F.sha2("text", 256).alias("text_sha256")]
    # a generator keeps filters and projections above it from computing the text and its digest again and again
    texts = texts.withColumn("digest", digest(F.col("text"))).select(F.inline(F.array(F.struct("doc_id", "digest", "text"))))
    entries = stage_table(texts.select("doc_id", "digest", *own_sha), "digests")
    index = MergeIndex(spark, scratch_path(spark, "digest-index"), memtable_rows, fanout)
    index.flush(entries.select("doc_id", "digest"))
    several = stage_table(index.compact().where("n > 1"), "digests-of-several")
    bits = filter_bits(several.count())
    bitmaps = stage_table(hit_filter(several, bits), "hit-filter")
    # what no filter holds is alone; of the others, hot digests are broadcast and false hits find no group
    total = several.agg(F.sum("n").alias("total"))
    hot = several.crossJoin(F.broadcast(total)).where(F.col("n") * HOT > F.col("total")).drop("total")
    maybe = may_hit(entries, bitmaps, bits)
    groups = maybe.join(F.broadcast(hot), "digest").unionByName(maybe.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(several, "digest", "left"), allowMissingColumns=True)
    groups = groups.unionByName(probe(entries, bitmaps, bits, "digest", False).withColumns({"keep_id": F.lit(None).cast("long"), "n": F.lit(None).cast("long")}))
    found = groups.withColumns({"keep_id": F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")), "n": F.coalesce("n", F.lit(1).cast("long"))})
    failed = stage_table(unequal_hits(stage_table(may_hit(texts, bitmaps, bits), "hit-texts"), several), "unequal-hits")
    sha = F.col("text_sha256") if digest is not sha256 else F.lower(F.hex("digest"))
    if failed.isEmpty():
        return found.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), sha.alias("text_sha256"))
    own = failed.groupBy("digest", F.sha2("text", 512).alias("bytes"), "text").agg(F.min("doc_id").alias("own_id"), F.count("*").alias("own_n"))
    again = failed.join(own, ["digest", "text"]).select(F.col("doc_id").alias("again_id"), F.col("digest").alias("again"), F.sha2("text", 256).alias("own_sha"), "own_id", "own_n").dropDuplicates()
    fewer = failed.groupBy("digest").agg(F.count("*").alias("fewer"))
    first = F.when(F.col("own_n").isNotNull(), F.col("own_id")).otherwise(F.col("keep_id"))
    same = F.col("doc_id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again")) & (F.col("sha") == F.col("own_sha"))
    return (
        found.withColumn("sha", sha).join(again, same, "left").join(fewer, "digest", "left")
        .select("doc_id", first.alias("keep_id"), F.coalesce("own_n", F.col("n") - F.coalesce("fewer", F.lit(0))).alias("group_size"), F.col("doc_id").eqNullSafe(first).alias("kept"), F.col("sha").alias("text_sha256"))
    )

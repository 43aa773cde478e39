"""From raw documents to tokens: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. As that is so, each stage first deletes the scratch
tables of the stages before it, and no others.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlake.llm import bpe_codec, exact_dedup, language_id, mixing, near_dedup
from termlake.llm.common import fresh, owned, release, scratch_path, stage_table


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(of: Stage) -> Stage:
    """A stage that owns its scratch tables and deletes those of the stage before, whose result is stored by then."""

    @functools.wraps(of)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, "pipeline")
        with owned("pipeline"):
            return of(spark, docs, sf_dir)

    return run_stage


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Profiles come from all documents with a lang; documents without a letter go, and no others."""
    # a prefix keeps a lang that is called `und` apart from UNKNOWN; without any lang, an empty profile is met by all texts with letters
    profiles = {f"={lang}": vector for lang, vector in language_id.learn_profiles(docs).items()} or {"=": np.zeros(language_id.DIM)}
    lang, score = fresh(docs.columns, "lang_pred", "score")
    found = language_id.identify(docs, profiles, added=(lang, score))
    return found.where(F.col(lang) != language_id.UNKNOWN).select(*docs.columns)


@stage
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised text the one with the smallest doc_id stays, one row of it.

    Rows are told apart by doc_id, null being one value, and digest. Those whose digest no other row has, by a filter, stay as
    they are; of the others, repeated rows become one before those that go are joined out.
    """
    found = stage_table(exact_dedup.exact_duplicates(docs), "pipeline-exact")
    own, gone_id, gone_sha = fresh(docs.columns, "own_sha", "gone_id", "gone_sha")
    several = found.where("group_size > 1").select(F.col("text_sha256").alias(own)).distinct()
    bits = exact_dedup.filter_bits(several.count())
    keyed = docs.withColumn(own, F.sha2(exact_dedup.normalised(F.col("text")), 256))
    bitmaps = stage_table(exact_dedup.hit_filter(several, bits, own), "pipeline-filter")
    alone, shared = (exact_dedup.probe(keyed, bitmaps, bits, own, hit) for hit in (False, True))
    gone = found.where("not kept").select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha))
    same = F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(own) == F.col(gone_sha))
    return alone.unionByName(shared.dropDuplicates(["doc_id", own]).join(gone, same, "left_anti")).select(*docs.columns)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of the smallest doc_id, and of several with that id the one
    with the smallest digest; rows without doc_id stay. Rows are told apart by doc_id and digest."""
    digest = F.conv(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 15), 16, 10).cast("long")
    gone_id, gone_tie = fresh(docs.columns, "gone_id", "gone_tie")
    gone = near_dedup.near_duplicates(docs, tie=digest).where(~F.col("kept")).select(F.col("doc_id").alias(gone_id), F.col("tie").alias(gone_tie)).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col(gone_id)) & (digest == F.col(gone_tie)), "left_anti").select(*docs.columns)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


@stage
def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text that they decode to."""
    import public_tokenizers

    ranks = bpe_codec.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    decoded = bpe_codec.decode(bpe_codec.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_and_decode),
]

#: Language profiles, sampling of shingles and BPE have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        path = scratch_path(spark, "stage-" + name.split()[0], keep=True)
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

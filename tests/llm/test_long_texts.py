"""Texts of 200,000 words and a word of a million letters, beside null and short ones: operators take them whole."""

import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from termlake.llm import bpe_codec, exact_dedup, lm_scoring, mixing, near_dedup, sharding, token_files

WORDS = [f"w{i * 7919 % 50_021}" for i in range(200_000)]
LONG = " ".join(WORDS)
EDITED = " ".join([*WORDS[:-1], "other"])  # differs in its last word only
TEXTS = {1: LONG, 2: LONG.replace(" ", "  "), 3: EDITED, 4: "x" * 1_000_000, 5: None, 6: "short"}


@pytest.fixture(scope="module")
def long(spark):
    return spark.createDataFrame([(i, t, "s") for i, t in TEXTS.items()], "doc_id bigint, text string, source string")


def test_copies(long):
    exact = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_duplicates(long).collect()}
    assert exact == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 1), 5: (5, 1), 6: (6, 1)}
    near = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(long).collect()}
    assert near == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}


def test_tokens(long):
    ranks = bpe_codec.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe_codec.decode(bpe_codec.encode(long, ranks, public_tokenizers.PATTERN), ranks).collect():
        text = TEXTS[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == whole.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    library = Tokenizer.from_str(vocabulary)
    for r in token_files.read_tokens(token_files.write_tokens(long, vocabulary, 1)).collect():
        want = [*library.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids, 1]
        assert np.frombuffer(r["ids"], "<u4").tolist() == want


def test_sizes(long):
    for r in sharding.shard_documents(long, 4).collect():
        raw = (TEXTS[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    assert {r["doc_id"]: r["size"] for r in mixing.mix(long).collect()} == {i: len((t or "").split()) for i, t in TEXTS.items()}
    scored = lm_scoring.score_documents(long, F.col("doc_id") == 3).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in scored} == {i: len((t or "").split()) + 1 for i, t in TEXTS.items()}
    assert next(r["n_known"] for r in scored if r["doc_id"] == 3) == len(WORDS)
    assert hashlib.sha256(LONG.encode()).hexdigest() in {r["text_sha256"] for r in exact_dedup.exact_duplicates(long).collect()}


def test_near_duplicates_store_less_than_the_texts(spark):
    """Shingles are made of coded words where they are needed: eight bytes for each shingle were half as much again as these texts."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(3000)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(vocabulary, k=300))) for i in range(400)], "doc_id bigint, text string")
    coded, signed, total = near_dedup.signed_documents(docs.select("doc_id", F.lit(0).cast("long").alias("tie"), F.col("text").cast("binary").alias("text")))
    stored = sum(os.path.getsize(x.removeprefix("file:")) for x in coded.inputFiles())
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    assert total == signed.count() == 400 and stored < 0.7 * size

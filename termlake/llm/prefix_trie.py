"""The trie of conversation prefixes: who shares which first turns, and what a cache of them would save.

A node is a distinct sequence of first turns. Its key is a polynomial of the turns' digests modulo 2**127 - 1, which can be
computed from the keys of two parts. So the turns, sorted over the whole table, are read once: each range of them is folded
alone, and the fold of what a conversation has in ranges before comes to it by range. A conversation of any length lies in many ranges.

Edges from a node to its parent are keyed by these digests. Rounds of pointer jumping add up subtrees: after round k a node has the sums
of all nodes less than 2**k below it and points to its ancestor 2**k above. So rounds grow with the logarithm of the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlake.llm.common import WORD, join_counted, lean, rows_of, ship, stage_table

ship(__name__)

PRIME = 2**127 - 1
BASE = int.from_bytes(hashlib.sha256(b"conversation prefixes").digest(), "big") % PRIME
INVERSE = pow(BASE, -1, PRIME)
#: Key of the empty sequence: no polynomial has it.
ROOT = b"\xff" * 16
#: Conversations are rebuilt from the one that begins their group of so many ids.
GROUP = 20
#: Rebuilt turns that come from there, at most one less.
HEADS = 4
#: Leading characters that order turns of one number.
LEAD = 256
#: Bytes of joined ids in a row.
CHUNK = 1 << 20

FOLDED = "conv_id bigint, part int, at bigint, words bigint, turn binary, prefix binary"
MEMBERS = "conv_id bigint, depth bigint, key binary, parent binary, words bigint, last boolean"


def _number(digest: bytes) -> int:
    return int.from_bytes(digest, "big") % PRIME


def _key(value: int) -> bytes:
    return value.to_bytes(16, "big")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted range with their place and prefix in their conversation's part of it. At the end the first and the last
    conversation of the range: at is -1, words its number of turns, prefix its whole part."""
    part, first, conv, n, prefix = TaskContext.get().partitionId(), None, None, 0, 0
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("words", pa.int64()), ("turn", pa.binary()), ("prefix", pa.binary())])
    for batch in batches:
        ids, turns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        places, prefixes = [], []
        for own, turn in zip(ids, turns, strict=True):
            if own != conv:
                if first is None and conv is not None:
                    first = (conv, n, prefix)
                conv, n, prefix = own, 0, 0
            prefix = (prefix * BASE + _number(turn)) % PRIME
            places.append(n)
            prefixes.append(_key(prefix))
            n += 1
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(places, pa.int64()), batch.column(2), batch.column(1), pa.array(prefixes, pa.binary())], schema=schema)
    for own, m, value in [x for x in (first, (conv, n, prefix)) if x and x[0] is not None]:
        yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([part], pa.int32()), pa.array([-1]), pa.array([m]), pa.array([b""], pa.binary()), pa.array([_key(value)], pa.binary())], schema=schema)


def _carry(edges: pa.Table) -> pa.Table:
    """For each range after the first of a conversation what the ones before it hold."""
    before, carried, out = 0, 0, []
    for x in edges.sort_by("part").to_pylist():
        if before:
            out.append({"conv_id": x["conv_id"], "part": x["part"], "before": before, "carried": _key(carried)})
        before, carried = before + x["words"], (carried * pow(BASE, x["words"], PRIME) + _number(x["prefix"])) % PRIME
    return pa.Table.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("before", pa.int64()), ("carried", pa.binary())]))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their place and prefix in the whole conversation, from (conv_id, at, words, turn, prefix, before, carried)."""
    for batch in batches:
        places, prefixes = batch.column(1).to_pylist(), batch.column(4).to_pylist()
        for i, (before, carried) in enumerate(zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True)):
            if before:
                prefixes[i] = _key((_number(carried) * pow(BASE, places[i] + 1, PRIME) + _number(prefixes[i])) % PRIME)
                places[i] += before
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.int64()), *batch.columns[2:4], pa.array(prefixes, pa.binary())], names=["conv_id", "place", "words", "turn", "prefix"])


def place_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), words, turn (digest), prefix (key of the turns so far) of all turns, stored."""
    c = F.col
    rows = rows_of(conversations, conv_id=c("conv_id").cast("long"), turn=c("turn"), role=F.coalesce(c("role"), F.lit("")), text=F.coalesce(c("text"), F.lit(""))).where("conv_id IS NOT NULL")
    digest = F.substring(F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)), 1, 16)
    lead = [F.substring(x, 1, LEAD) for x in ("role", "text")]
    turns = rows.select("conv_id", "turn", lead[0].alias("role"), lead[1].alias("text"), digest.alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"))
    keys = ["conv_id", "turn", "role", "text", "digest", "row"]
    ranged = turns.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "digest", "words")
    folded = stage_table(ranged.mapInArrow(lean(_fold), FOLDED), "trie-folded")
    # two edges a range at most, of which one has something before it
    carries = folded.where("at < 0").select("conv_id", "part", "words", "prefix").groupBy("conv_id").applyInArrow(_carry, "conv_id bigint, part int, before bigint, carried binary")
    known = folded.where("at >= 0").join(F.broadcast(carries), ["conv_id", "part"], "left").select("conv_id", "at", "words", "turn", "prefix", "before", "carried")
    return stage_table(known.mapInArrow(lean(_placed), "conv_id bigint, place bigint, words bigint, turn binary, prefix binary"), "trie-turns")


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Own turns behind a head: their keys are moved from the conversation's own first turns to those of the head."""
    for batch in batches:
        keys, parents, depths = [], [], []
        columns = (batch.column(i).to_pylist() for i in range(1, 8))
        for place, turn, prefix, h, m, head, own in zip(*columns, strict=True):
            key, after = _number(prefix), place - h + 1
            if head != own:
                key = (key + (_number(head) - _number(own)) * pow(BASE, after, PRIME)) % PRIME
            depths.append(m + after)
            keys.append(_key(key))
            parents.append(_key((key - _number(turn)) * INVERSE % PRIME) if m + after > 1 else ROOT)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(depths, pa.int64()), pa.array(keys, pa.binary()), pa.array(parents, pa.binary()), batch.column(8), batch.column(9)], names=["conv_id", "depth", "key", "parent", "words", "last"])


def members(turns: DataFrame) -> DataFrame:
    """conv_id, depth, key, parent, words, last for every rebuilt conversation and depth from 0, stored; last marks its whole length."""
    zero, h = F.lit(bytes(16)), F.crc32(F.col("conv_id").cast("string")) % HEADS
    opening = turns.where(F.col("place") < HEADS - 1)
    heads = opening.where(F.col("conv_id") % GROUP == 0).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "prefix", "words"))).alias("turns")).withColumnRenamed("conv_id", "base")
    own = opening.where(F.col("place") == h - 1).select("conv_id", F.col("prefix").alias("own"))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"base": F.col("conv_id") - F.col("conv_id") % GROUP, "h": h})
    convs = convs.join(heads, "base", "left").join(own, "conv_id", "left").withColumn("turns", F.expr("slice(coalesce(turns, array()), 1, cast(h AS int))"))
    convs = convs.withColumn("m", F.size("turns").cast("long")).withColumns({"head": F.coalesce(F.expr("try_element_at(turns, -1).prefix"), zero), "own": F.coalesce("own", zero)})
    convs = stage_table(convs.select("conv_id", "n", "h", "m", "head", "own", "turns"), "trie-conversations")
    bare = F.col("n") <= F.col("h")
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("words"), (bare & (F.col("m") == 0)).alias("last"))
    begun = convs.select("conv_id", "m", bare.alias("bare"), "turns", F.posexplode("turns").alias("i", "t"))
    begun = begun.select("conv_id", (F.col("i") + 1).cast("long").alias("depth"), F.col("t.prefix").alias("key"), F.when(F.col("i") > 0, F.expr("turns[i - 1].prefix")).otherwise(F.lit(ROOT)).alias("parent"), F.col("t.words").alias("words"), (F.col("bare") & (F.col("i") + 1 == F.col("m"))).alias("last"))
    behind = join_counted(turns, convs.drop("turns"), "conv_id").where("place >= h")
    behind = behind.select("conv_id", "place", "turn", "prefix", "h", "m", "head", "own", "words", (F.col("place") == F.col("n") - 1).alias("last")).mapInArrow(lean(_rebuilt), MEMBERS)
    return stage_table(roots.unionByName(begun).unionByName(behind), "trie-members")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range sorted by (key, conv_id): the digest of a key's joined ids if the range has all of them for certain, else the
    joined ids in chunks (the first and the last key)."""
    hashed, held, key, first, outer = hashlib.sha256(), b"", None, None, True

    def row(sha: str | None, data: bytes | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([first], pa.int64()), pa.array([data], pa.binary()), pa.array([sha], pa.string())], names=["key", "first", "ids", "sha"])

    done: list[tuple[bytes, str]] = []
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        for own, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if own != key:
                if key is not None and outer:
                    yield row(None, held)
                elif key is not None:
                    hashed.update(held)
                    done.append((key, hashed.hexdigest()))
                outer, key, hashed, held, first, kept = key is None, own, hashlib.sha256(), b"", conv, []
            said = b"%d" % conv
            if len(held) > CHUNK:
                if outer:
                    yield row(None, held)
                else:
                    kept.append(row(None, held))  # the key may be the last one
                    hashed.update(held + b",")
                held, first = said, conv
            else:
                held = held + b"," + said if held else said
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.nulls(len(done), pa.int64()), pa.nulls(len(done), pa.binary()), pa.array([x for _, x in done])], names=["key", "first", "ids", "sha"])
            done = []
    if key is not None:
        yield from kept
        yield row(None, held)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each key's chunks, which come in order and are held one at a time."""
    key, hashed, names = None, hashlib.sha256(), ["key", "sha"]
    for batch in batches:
        for own, ids in zip(batch.column(0), batch.column(1), strict=True):
            if (own := own.as_py()) != key:
                if key is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([hashed.hexdigest()])], names=names)
                key, hashed = own, hashlib.sha256()
            else:
                hashed.update(b",")
            hashed.update(ids.as_py())
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([hashed.hexdigest()])], names=names)


def ends(member: DataFrame) -> DataFrame:
    """key, sha: the digest of the ids, ascending and joined, of the conversations that end at a node. A digest of a sequence
    has to be taken in its order; only joined ids in chunks of CHUNK bytes meet for it, one of them in memory at a time."""
    ending = member.where("last").select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    chunks = stage_table(ending.mapInArrow(lean(_chunks), "key binary, first bigint, ids binary, sha string"), "trie-ends")
    outer = chunks.where("sha IS NULL").select("key", "first", "ids").repartition("key").sortWithinPartitions("key", "first").select("key", "ids")
    return chunks.where("sha IS NOT NULL").select("key", "sha").unionByName(outer.mapInArrow(lean(_hashed), "key binary, sha string"))


def roll_up(nodes: DataFrame, sums: list[str], depth: int) -> DataFrame:
    """nodes (key, parent, ..., sums) with each of `sums` added up over the node's subtree; depth: that of the deepest node."""
    grown = nodes.withColumn("up", F.col("parent"))
    for k in range(depth.bit_length()):
        below = grown.where("up IS NOT NULL").groupBy("up").agg(F.count("*").alias("n"), *(F.sum(x).alias(f"{x}_below") for x in sums)).withColumnRenamed("up", "key")
        joined = grown.join(below, "key", "left").withColumns({x: F.col(x) + F.coalesce(f"{x}_below", F.lit(0)) for x in sums}).drop(*(f"{x}_below" for x in sums))
        joined = stage_table(joined, f"trie-sums-{k}")
        pointed = stage_table(joined.where("n IS NOT NULL").select(F.col("key").alias("up"), "n", F.col("up").alias("next")), f"trie-pointed-{k}")
        rows = joined.drop("n")
        jumped = join_counted(rows.where("up IS NOT NULL"), pointed, "up").drop("n", "up").withColumnRenamed("next", "up")
        grown = rows.where("up IS NULL").unionByName(jumped)
    return grown.drop("up")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the trie of
    rebuilt conversations of (conv_id, turn, role, text).

    Null roles and texts are empty; null turns come first. Turns of one number go by role, then text, by their first 256
    characters, then by digest; repeated rows are turns of their own. Rows without a conv_id belong to no conversation. Texts of any
    length count whole. Other columns stay behind. An empty table has no conversation, so no node and not even a root.
    """
    member = members(place_turns(conversations))
    nodes = member.groupBy("key").agg(F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("parent").alias("parent"), F.max("words").alias("words"))
    nodes = stage_table(nodes, "trie-nodes")
    depth = nodes.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    children = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n")).withColumnRenamed("parent", "key")
    nodes = nodes.join(children, "key", "left").withColumns({"n_children": F.coalesce("n", F.lit(0)), "n_leaves": F.col("n").isNull().cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}).drop("n", "words")
    nodes = stage_table(nodes.join(ends(member), "key", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(hashlib.sha256().hexdigest()))).drop("sha"), "trie-counted")
    parents = stage_table(nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("n_children").alias("n"), F.col("conv_id").alias("parent_conv_id")), "trie-parents")
    named = join_counted(nodes.where("parent IS NOT NULL"), parents, "parent").drop("n").unionByName(nodes.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")))
    summed = roll_up(stage_table(named, "trie-named"), ["n_leaves", "saved_tokens"], depth)
    return summed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")

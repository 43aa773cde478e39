"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles, banded, verified.

Texts with equal words are one node. A shingle of five words weighs its count times its IDF, which comes from the exact
number of documents that hold it. Nodes whose samples agree in a band meet in a bucket; pairs from buckets are verified by
weighted Jaccard similarity over all their shingles, and connected nodes are a class.

Document frequencies go by blocks of documents, as in blocks.py: a block sends its distinct shingles, in order and cut to
the bits that tell them apart, to the tasks of their hash ranges and gets back the number of documents for each. What is
stored of a block are its words as codes and the hash of each distinct one: shingles are made of them again where they are
needed, since eight bytes for each would be twice the texts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlake.llm import blocks as B
from termlake.llm.common import bucketed_table, join_counted, lean, lean_pair, lean_table, rows_of, ship, small_batches, stage_table
from termlake.llm.components import components
from termlake.llm.exact_dedup import filter_bits, hit_filter, looked_up, marked_hits, may_hit

ship(__name__)

WORDS = 5
SIMILAR = 0.8
BANDS = 16
ROWS = 4
SEED = 1
#: Randomness of the sampling: a shingle's hash picks one of so many rows.
TABLE = 1 << 16
#: IDF runs from 1 for a shingle of one document down to FLOOR for one of all: FLOOR + (1 - FLOOR) * ln(N / df) / ln(N).
#: Undamped, what a group of thousands of near copies shares would weigh so little beside the words of an edit that
#: texts with nine tenths of their shingles in common fell below 0.8.
FLOOR = 0.75
#: Shingles of a block of documents, repeats counted; shingles, about, whose counts one hash range holds.
TOGETHER = 1_200_000
PART_SHINGLES = 2_000_000
#: Bits of a shingle's hash beyond the logarithm of the number of shingles: a chance of 2**-24 that one meets another.
SPARE_BITS = 24
#: Buckets of so many nodes give all their pairs; in larger ones all nodes are compared with chosen ones.
SMALL = 8
#: Nodes of a block in those comparisons, about.
BLOCK = 1024


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of hashed words, in order, and their counts.

    One to four words are one shingle; no words have none.
    """
    n = max(len(words) - WORDS + 1, min(1, len(words)))
    out = np.zeros(n, np.uint64)
    for i in range(min(WORDS, len(words))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out, return_counts=True)


CODED = "block string, doc_id bigint, tie bigint, digest binary, n bigint, words binary, known binary"

CODED_AS = pa.schema([("block", pa.string()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("words", pa.binary()), ("known", pa.binary())])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text that has words: its block, a digest of its words, A-Z lowered, the number of its shingles, repeats counted, and
    the codes of its words in the block; and a row for each block, with the hash of each code in `known`."""
    from uuid import uuid4

    codes, block, held = B._Codes(), uuid4().hex, 0

    def known() -> tuple:
        return block, None, None, None, None, None, np.fromiter(map(xxhash.xxh3_64_intdigest, codes), "<u8", len(codes)).tobytes()

    for batch in batches:
        rows = []
        for doc_id, tie, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            words = (text.as_py() or b"").lower().split()
            if not words:
                continue
            n = max(len(words) - WORDS + 1, 1)
            own = np.fromiter(map(codes.__getitem__, words), np.uint32, len(words))
            rows.append((block, doc_id, tie, xxhash.xxh3_128_digest(b" ".join(words)), n, B.pack_ints(own), None))
            held += n
            if held >= TOGETHER:
                rows.append(known())
                codes, block, held = B._Codes(), uuid4().hex, 0
        yield pa.RecordBatch.from_pydict(dict(zip(CODED_AS.names, zip(*rows, strict=True), strict=True)) if rows else {x: [] for x in CODED_AS.names}, CODED_AS)
    if held:
        yield pa.RecordBatch.from_pydict(dict(zip(CODED_AS.names, ([x] for x in known()), strict=True)), CODED_AS)


def _documents(block: pa.Table) -> tuple[pa.Table, list[tuple[np.ndarray, np.ndarray]]]:
    """The rows of a block's documents, and for each its distinct shingles in order and how often each occurs in it."""
    (known,) = block.column("known").drop_null()
    known, own = np.frombuffer(known.as_buffer(), "<u8"), block.filter(pc.is_valid(block.column("words")))
    return own, [shingles(known[B.unpack_ints(x.as_py())]) for x in own.column("words")]


def _unfold(block: pa.Table) -> pa.Table:
    own, sets = _documents(block)
    counts = [None if (n == 1).all() else B.pack_ints(n) for _, n in sets]
    return pa.table({"doc_id": own.column("doc_id"), "digest": own.column("digest"), "keys": pa.array([B.pack_sorted(k) for k, _ in sets], pa.binary()), "counts": pa.array(counts, pa.binary())})


def _send(parts: int, bits: int):
    def send(block: pa.Table) -> pa.Table:
        """For each hash range a row with the block's distinct shingles in it and the number of its documents with each."""
        keys, n = np.unique(np.concatenate([k for k, _ in _documents(block)[1]]), return_counts=True)
        keys = keys >> np.uint64(64 - bits)
        edges = np.searchsorted(keys, np.array([(p << bits) // parts for p in range(parts)], dtype=np.uint64)).tolist() + [len(keys)]
        some = [p for p in range(parts) if edges[p] < edges[p + 1]]
        name = block.column("block")[0].as_py()
        own = [slice(edges[p], edges[p + 1]) for p in some]
        return pa.table({"part": pa.array(some, pa.int32()), "block": [name] * len(some), "keys": [B.pack_sorted(keys[x]) for x in own], "n": [B.pack_ints(n[x]) for x in own]})

    return send


def _count(table: pa.Table) -> pa.Table:
    """For each block's shingles, in their order, the number of documents of all blocks."""
    keys = [B.unpack_sorted(x.as_py()) for x in table.column("keys")]
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(at, weights=np.concatenate([B.unpack_ints(x.as_py()) for x in table.column("n")]))
    found = np.split(sums[at].astype(np.uint32), np.cumsum([len(x) for x in keys])[:-1])
    return pa.table({"block": table.column("block"), "part": table.column("part"), "found": pa.array([B.pack_ints(x) for x in found], pa.binary())})


def weights_of(counts: np.ndarray | None, documents: np.ndarray, total: int) -> np.ndarray:
    """Count times IDF of shingles that are in so many of all `total` documents; counts None: once each."""
    idf = FLOOR + (1 - FLOOR) * np.log(total / documents) / np.log(total) if total > 1 else np.ones(len(documents))
    return idf if counts is None else counts * idf


Tables = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _randomness() -> Tables:
    """r, ln c and beta of the sampling for each table row and sample, and ln a for weight 1."""
    random = np.random.default_rng(SEED)
    shape = (TABLE, BANDS * ROWS)

    def gamma() -> np.ndarray:
        """Of shape 2: minus the logarithm of the product of two numbers in (0, 1]."""
        return np.maximum(-np.log((1 - random.random(shape, np.float32)) * (1 - random.random(shape, np.float32))), np.float32(1e-6))

    r, c = gamma(), np.log(gamma())
    beta = random.random(shape, np.float32)
    return r, c, beta, c - r * (1 - beta)


def samples(keys: np.ndarray, weights: np.ndarray, tables: Tables) -> np.ndarray:
    """For each of the samples a number that two weighted sets share with the probability of their weighted Jaccard similarity."""
    r, c, beta, ln_a_of_one = tables
    best, chosen, step = np.full(BANDS * ROWS, np.inf, np.float32), np.zeros(BANDS * ROWS, np.uint64), np.zeros(BANDS * ROWS, np.int64)
    for a in range(0, len(keys), 4096):
        part, logs = keys[a : a + 4096], np.log(weights[a : a + 4096]).astype(np.float32)
        at = (part & np.uint64(TABLE - 1)).astype(np.int64)
        ln_a, t = ln_a_of_one[at], np.zeros((len(part), 1), np.int64)
        odd = np.flatnonzero(logs)
        if len(odd):
            t = np.zeros((len(part), BANDS * ROWS), np.int64)
            steps = np.floor(logs[odd, None] / r[at[odd]] + beta[at[odd]])
            t[odd], ln_a[odd] = steps.astype(np.int64), c[at[odd]] - r[at[odd]] * (steps - beta[at[odd]] + 1)
        least = ln_a.argmin(axis=0)
        value = ln_a[least, np.arange(BANDS * ROWS)]
        nearer = value < best
        best = np.where(nearer, value, best)
        chosen = np.where(nearer, part[least], chosen)
        step = np.where(nearer, t[least, np.arange(BANDS * ROWS) if t.shape[1] > 1 else 0], step)
    return chosen ^ (step.view(np.uint64) * np.uint64(0x94D049BB133111EB))


def band_hashes(keys: np.ndarray, weights: np.ndarray, tables: Tables) -> np.ndarray:
    """A hash for each band, of its number and its samples."""
    by_band = samples(keys, weights, tables).reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        out = (out ^ by_band[:, i]) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


SIGNED = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("documents", pa.binary())])


def _sign(total: int):
    def sign(block: pa.Table, counted: pa.Table) -> pa.Table:
        """Band hashes of a block's documents, and for each of their shingles the number of documents with it."""
        tables, counted = _randomness(), counted.sort_by("part")
        own, sets = _documents(block)
        keys, ends = np.concatenate([k for k, _ in sets]), np.cumsum([len(k) for k, _ in sets]).tolist()
        at = np.unique(keys, return_inverse=True)[1]
        documents = np.concatenate([B.unpack_ints(x.as_py()) for x in counted.column("found")])[at]
        bands, packed = [], []
        for a, b, (_, counts) in zip([0, *ends[:-1]], ends, sets, strict=True):
            weights = weights_of(None if (counts == 1).all() else counts, documents[a:b], total)
            bands.append(band_hashes(keys[a:b], weights, tables))
            packed.append(B.pack_ints(documents[a:b]))
        return pa.table({"doc_id": own.column("doc_id"), "tie": own.column("tie"), "digest": own.column("digest"), "bands": pa.array(bands, pa.list_(pa.int64())), "documents": pa.array(packed, pa.binary())}, SIGNED)

    return sign


def _sets(total: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [weights_of(B.unpack_ints(c.as_py()) if c.is_valid else None, B.unpack_ints(d.as_py()), total) for c, d in zip(batch.column(2), batch.column(3), strict=True)]
            # quarters of a percent would do; floats keep the verification exact
            yield pa.RecordBatch.from_pydict({"digest": batch.column(0), "keys": batch.column(1), "weights": pa.array([B.squeeze(w.astype("<f4").tobytes()) for w in weights], pa.binary())})

    return sets


def _load(keys: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    return B.unpack_sorted(keys), np.frombuffer(B.expand(weights), "<f4").astype(np.float64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (keys in order, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float(np.minimum(a[1][i], b[1][j]).sum())
    whole = float(a[1].sum() + b[1].sum()) - shared
    return shared / whole if whole else 0.0


def _verify(least: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, *sets = batch.columns
            out = [similarity(_load(x.as_py(), y.as_py()), _load(z.as_py(), w.as_py())) for x, y, z, w in zip(*sets, strict=True)]
            keep = pa.array([s >= least for s in out], pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep), pa.array(out, pa.float64()).filter(keep)], names=["a", "b", "similarity"])

    return verify


def _verify_block(least: float):
    def verify(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        sets = [_load(r["keys"], r["weights"]) for r in rows]
        sums = np.array([w.sum() for _, w in sets])
        # where each shingle of the block occurs: similarities of a node with all later ones come from one pass over its shingles
        keys, at = np.unique(np.concatenate([k for k, _ in sets]), return_inverse=True)
        node = np.repeat(np.arange(len(sets)), [len(k) for k, _ in sets])
        weight = np.concatenate([w for _, w in sets])
        order = np.argsort(at, kind="stable")
        starts = np.searchsorted(at[order], np.arange(len(keys) + 1))
        ends = np.cumsum([len(k) for k, _ in sets])
        classes = np.array([int.from_bytes(r["class"][:7], "big") for r in rows])
        own = np.array([r["own"] for r in rows])
        one, out = rows[0]["x"] == rows[0]["y"], []
        # of two nodes of different classes one at least is not of the commonest
        kinds, many = np.unique(classes, return_counts=True)
        common = classes == kinds[many.argmax()]
        for i in np.flatnonzero(~common).tolist():
            end = int(ends[i])
            mine = at[end - len(sets[i][0]) : end]
            sizes = starts[mine + 1] - starts[mine]
            places = order[np.repeat(starts[mine] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))]
            shared = np.bincount(node[places], np.minimum(np.repeat(sets[i][1], sizes), weight[places]), len(sets))
            found = shared / (sums + sums[i] - shared)
            for j in np.flatnonzero((found >= least) & ((np.arange(len(sets)) > i) | common) & (classes != classes[i]) & (one | (own != own[i]))).tolist():
                a, b = sorted((rows[i]["digest"], rows[j]["digest"]))
                out.append((a, b, float(found[j])))
        return pa.table(list(map(list, zip(*out, strict=True))) or [[], [], []], pa.schema([("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64())]))

    return verify


class _Verifier:
    """Compares pairs of nodes by their shingles; only shingles of nodes in a pair leave their task."""

    def __init__(self, coded: DataFrame, signed: DataFrame, nodes: DataFrame, total: int, least: float) -> None:
        self.coded, self.signed, self.nodes, self.total, self.least = coded, signed, nodes, total, least
        self.sets: list[DataFrame] = []

    def _beside(self, rows: DataFrame, key: str, prefix: str = "") -> DataFrame:
        """rows with the set of the node in `key`. Sets stay in their buckets of digests: only rows are shuffled to them, and those of
        one bucketed table are not united with another's before, as a union has no buckets."""
        asked = rows.select(key)
        sets = (x.toDF(key, f"{prefix}keys", f"{prefix}weights").join(asked, key, "left_semi") for x in self.sets)
        return functools.reduce(DataFrame.unionByName, [rows.join(x, key) for x in sets])

    def links(self, pairs: DataFrame) -> DataFrame:
        """(a, b, similarity) of those pairs (a, b) that are similar."""
        wanted = pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct()
        for sets in self.sets:
            wanted = wanted.join(sets.select("digest"), "digest", "left_anti")
        wanted = stage_table(wanted.join(self.nodes, "digest").select("digest", "doc_id"), "near-wanted")
        if not self.sets or not wanted.isEmpty():
            # each false hit shuffles its whole set, so the filter is four times as large as for rows of a digest
            bits = filter_bits(4 * wanted.count())
            own = hit_filter(wanted, bits, "doc_id")
            # by digest alone, as what follows: with doc_id as a key of the join, all would be shuffled once more
            asked = wanted.withColumnRenamed("doc_id", "wanted_id")
            of = lambda rows: rows.join(asked, "digest").where("doc_id between wanted_id and wanted_id").drop("wanted_id").dropDuplicates(["digest"]).drop("doc_id")
            # a block keeps its hashes of words and the documents that are wanted, where it is stored
            near = marked_hits(self.coded.select("block", "doc_id", "digest", "words", "known"), own, bits, "doc_id", "near").where("near or words is null")
            unfolded = near.groupBy("block").applyInArrow(lean_table(_unfold), "doc_id bigint, digest binary, keys binary, counts binary")
            keys, documents = of(unfolded), of(may_hit(self.signed.select("doc_id", "digest", "documents"), own, bits, "doc_id"))
            both = keys.join(documents, "digest").select("digest", "keys", "counts", "documents")
            self.sets.append(bucketed_table(both.mapInArrow(lean(_sets(self.total)), "digest binary, keys binary, weights binary"), "near_sets", "digest"))
        # the set of a goes to the one of b: of many pairs with one center, the center is a mostly, so they spread over tasks
        both = self._beside(self._beside(pairs, "a", "a_"), "b", "b_").select("a", "b", "a_keys", "a_weights", "b_keys", "b_weights")
        return stage_table(both.mapInArrow(lean(_verify(self.least)), "a binary, b binary, similarity double"), "near-links")

    def links_across(self, members: DataFrame) -> DataFrame:
        """Links between all nodes of different classes in each bucket of members (bucket, digest, n, class), by pairs of blocks.

        The nodes of a bucket hash into blocks of BLOCK about. A node goes to each pair of blocks with its own; one task
        compares the nodes of a pair of blocks. So a bucket's comparisons spread over tasks of bounded size.
        """
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        dealt = members.withColumn("own", F.pmod(F.xxhash64("digest", "bucket"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        dealt = dealt.select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "class", "digest")
        found = self._beside(dealt, "digest").groupBy("bucket", "x", "y").applyInArrow(_verify_block(self.least), "a binary, b binary, similarity double")
        return stage_table(found.dropDuplicates(["a", "b"]), "near-links")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def signed_documents(texts: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Stored tables of texts (doc_id, tie, text as bytes): the coded words of each text that has words, its bands with the document
    frequencies of its shingles in their order; and the number of those texts."""
    coded = bucketed_table(texts.mapInArrow(lean(_encode), CODED), "near_words", "block")
    total, whole = coded.agg(F.count("words"), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts, bits = whole // PART_SHINGLES + 1, min(63, max(whole, 1).bit_length() + SPARE_BITS)
    sent = coded.select("block", "words", "known").groupBy("block").applyInArrow(lean_table(_send(parts, bits)), "part int, block string, keys binary, n binary")
    counted = sent.groupBy("part").applyInArrow(lean_table(_count), "block string, part int, found binary")
    own = coded.select("block", "doc_id", "tie", "digest", "words", "known").groupBy("block")
    signed = own.cogroup(counted.groupBy("block")).applyInArrow(lean_pair(_sign(total)), "doc_id bigint, tie bigint, digest binary, bands array<bigint>, documents binary")
    return coded, stage_table(signed, "near-signed"), total


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, tie: Column | None = None) -> DataFrame:
    """doc_id, class_id, class_size, kept and, if asked for, tie for each row of docs (doc_id, text).

    A class is a set of documents connected by similarities of `similar` or more; class_id is its smallest doc_id,
    whose rows are kept, and of these the ones with the smallest `tie`, an integer, if there is one. Texts without words, null ones too, are no one's duplicates, and rows without doc_id have no class and
    are kept. Rows that repeat a doc_id with other words belong to the class of their own words. A text longer than a block is a
    block of its own, whatever its length. Columns but doc_id and text stay behind. An empty table gives an empty result.
    A pair of exactly that similarity meets in no bucket with probability (1 - similar ** ROWS) ** BANDS, 2e-4 at 0.8.
    Buckets have no cap: in large ones each node is compared with one, and where that leaves several classes, all
    pairs across classes are, in blocks.
    """
    small_batches(docs.sparkSession)
    rows = rows_of(docs, doc_id=F.col("doc_id").cast("long"), tie=(F.lit(0) if tie is None else tie).cast("long"), text=F.col("text"))
    coded, signed, total = signed_documents(rows.withColumn("text", F.col("text").cast("binary")))
    usable = signed.where("doc_id is not null")
    # equal texts have equal bands, so those of any row of a node will do
    index = usable.groupBy("digest").agg(F.min(F.struct("doc_id", "tie", "bands")).alias("first"), F.count("*").alias("n"))
    keep = F.struct("first.doc_id", "first.tie").alias("keep")
    index = stage_table(index.select("digest", keep, F.col("first.doc_id").alias("keep_id"), "n", "first.bands"), "near-nodes")
    placed = index.select("digest", F.explode("bands").alias("band"))
    verifier = _Verifier(coded, signed, index.select("digest", F.col("keep_id").alias("doc_id")), total, similar)
    # first each node with one other, of all that it meets the one with the smallest digest, a hash itself: that links most copies
    centers = stage_table(placed.groupBy("band").agg(F.min("digest").alias("center"), F.count("*").alias("n")).where("n > 1"), "near-centers")
    # no other band brings a pair; most are alone, so they are not shuffled
    bits = filter_bits(centers.count())
    shared = may_hit(placed, hit_filter(centers, bits, "band"), bits, "band")
    placed = stage_table(join_counted(shared, centers, "band"), "near-shared")
    first = placed.groupBy("digest").agg(F.min("center").alias("center")).toDF("a", "b")
    links = verifier.links(stage_table(_ordered(first), "near-pairs"))
    classes = components(links)
    level = placed.select("digest", F.col("band").alias("bucket")).join(classes, F.col("digest") == F.col("node"), "left")
    level = stage_table(level.select("digest", "bucket", F.coalesce("component", "digest").alias("class")), "near-level")
    # across classes only: all pairs of a bucket of few nodes; each of many with one that a hash picks
    center = F.min_by(F.struct("digest", "class"), F.xxhash64("digest", "bucket")).alias("center")
    sizes = level.groupBy("bucket").agg(F.count("*").alias("n"), center, F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").drop("x", "y")
    members = stage_table(join_counted(level, stage_table(sizes, "near-sizes"), "bucket"), "near-members")
    few = members.where(F.col("n") <= SMALL).groupBy("bucket").agg(F.collect_list(F.struct("digest", "class")).alias("all"))
    few = few.select(F.explode("all").alias("p"), "all").select("p", F.explode("all").alias("q")).where("p.class < q.class").select("p.digest", "q.digest").toDF("a", "b")
    many = members.where(F.col("n") > SMALL)
    large = many.where("class <> center.class").select("digest", "center.digest").toDF("a", "b")
    links = links.union(verifier.links(stage_table(_ordered(few.union(large)), "near-pairs")))
    # what is left are large buckets of several classes: there every pair across classes is compared
    classes = components(links)
    now = many.select("bucket", "digest").join(classes, F.col("digest") == F.col("node"), "left")
    now = stage_table(now.select("bucket", "digest", F.coalesce("component", "digest").alias("class")), "near-many")
    mixed = now.groupBy("bucket").agg(F.count("*").alias("n"), F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("bucket", "n")
    now = stage_table(join_counted(now, stage_table(mixed, "near-mixed"), "bucket"), "near-across")
    if not now.isEmpty():
        links = links.union(verifier.links_across(now))
        classes = components(links)
    labelled = stage_table(index.join(classes, F.col("digest") == F.col("node"), "left").select("digest", "keep", "n", F.coalesce("component", "digest").alias("class")), "near-labelled")
    whole = stage_table(labelled.groupBy("class").agg(F.min("keep").alias("class_id"), F.sum("n").alias("class_size"), F.count("*").alias("n")), "near-classes")
    named = join_counted(labelled.select("digest", "class", F.col("n").alias("copies")), whole, "class")
    named = stage_table(named.select("digest", F.struct("class_id", "class_size").alias("of"), F.col("copies").alias("n")), "near-named")
    found = looked_up(usable.select("doc_id", "tie", "digest"), named.select("digest", F.col("of").alias("keep_id"), "n")).select("doc_id", "tie", "keep_id.*")
    found = found.select("doc_id", "tie", F.col("class_id.doc_id").alias("class_id"), "class_size", (F.struct("doc_id", "tie") == F.col("class_id")).alias("kept"))
    # all other rows stand for themselves: those without words, which have no shingles, and those without doc_id
    wordless = rows.where(F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    alone = wordless.select("doc_id", "tie", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return found.unionByName(alone).drop(*(["tie"] if tie is None else []))

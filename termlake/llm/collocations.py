"""Collocations: phrases of two to five words that occur more often than their parts suggest, by language.

Documents are dealt into shards of one language. A shard has for each frequent word a bitmap of its positions, in
words of WIDTH bits of which only those with a bit are kept. A phrase grows by a shift of its bitmap and an AND with the bitmaps of
the words that stand in the same WIDTH positions; the popcount is its number of occurrences in the shard. Phrases grow depth first, a batch
of first words at a time, so a shard's memory is bounded by its size. Breaks between pieces and words too rare for any
phrase keep a position without a bit, which no phrase crosses. Counts are sums over the shards.

No phrase is more frequent than the words and pairs in it. So shards meet for words, for pairs of frequent words, and for
longer phrases of frequent pairs. Each time they first send counts by hash bucket, about a byte a phrase: a bucket's sum is no
less than that of any phrase in it. The phrases themselves, whose counts are exact, follow only from buckets that are frequent. Buckets grow in
number with the words of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termlake.llm import blocks as B
from termlake.llm.common import bucketed_table, lean, lean_pair, lean_table, rows_of, ship, small_batches, stage_table

ship(__name__)

#: A shard ends with the document that brings it to so many words and breaks; longer documents are cut at a break.
SHARD = 3_000_000
#: Bitmap words that one batch of first words meets, at most, unless one word alone meets more; that is a shard's positions at most.
MEETINGS = 2_000_000
#: Words of the table for each bucket, and buckets that one task adds up.
BUCKET_WORDS, PART = 16, 2_000_000
LONGEST = 5
#: Bits of a bitmap word. A phrase meets as many words at each of its bitmap words, so narrow ones cost less.
WIDTH = 16
#: Parts of a language that are ranked apart before the whole is.
RANK_PARTS = 64
BREAK = b"."

SHARDS = "shard bigint, lang string, n bigint, ids binary, words binary"
SENT = pa.schema([("part", pa.int32()), ("shard", pa.int64()), ("keys", pa.binary()), ("n", pa.binary()), ("exact", pa.binary())])
KEPT = pa.schema([("shard", pa.int64()), ("kept", pa.binary())])
SPOKEN = pa.schema([("part", pa.int32()), ("shard", pa.int64()), ("lang", pa.string()), ("codes", pa.binary()), ("words", pa.binary()), ("n", pa.binary())])
NAMED = pa.schema([("shard", pa.int64()), ("codes", pa.binary()), ("gids", pa.binary()), ("gid", pa.int64()), ("lang", pa.string()), ("word", pa.binary()), ("f", pa.int64())])
FOUND = pa.schema([("g", pa.list_(pa.int64())), ("f", pa.int64())])


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.int64()): "array<bigint>"}
    return ", ".join(f"{x.name} {kinds[x.type]}" for x in schema)


def pack_wide(values: np.ndarray) -> bytes:
    """Integers by byte planes, which compress well apart: neighbours have their high bytes in common."""
    return B.squeeze(np.ascontiguousarray(np.ascontiguousarray(values, "<i8").reshape(-1).view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_wide(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(B.expand(data), np.uint8).reshape(8, -1).T).view("<i8").reshape(-1)


def split_words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lowered, with a BREAK between pieces."""
    breaks = bytes.maketrans(b",;:!?\n\x0b\x0c\r", BREAK * 9)
    return text.lower().translate(breaks).replace(BREAK, b" . ").split()


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


class _Shard:
    def __init__(self) -> None:
        self.codes, self.parts, self.n = _Codes({BREAK: 0}), [], 0

    def add(self, words: list[bytes]) -> None:
        self.parts += [np.fromiter(map(self.codes.__getitem__, words), np.uint32, len(words)), np.zeros(1, np.uint32)]
        self.n += len(words) + 1

    def row(self, shard: int, lang: str) -> pa.RecordBatch:
        ids = np.concatenate(self.parts)
        return pa.RecordBatch.from_pydict({"shard": [shard], "lang": [lang], "n": [int((ids > 0).sum())], "ids": pa.array([B.pack_ints(ids)], pa.binary()), "words": pa.array([B.pack_units(list(self.codes))], pa.binary())})


def _portions(words: list[bytes], most: int) -> Iterator[list[bytes]]:
    """The words, cut at the first break after each `most` of them: no phrase crosses one."""
    start = 0
    while len(words) - start > most and BREAK in words[start + most :]:
        end = words.index(BREAK, start + most)
        yield words[start:end]
        start = end
    yield words[start:]


def _to_shards(most: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, _Shard] = {}
        number, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for words in _portions(split_words(text.as_py() or b""), most):
                    shards.setdefault(lang, _Shard()).add(words)
                    held += len(words) + 1
                    while held >= most:  # the largest goes first
                        largest = max(shards, key=lambda x: shards[x].n)
                        held -= shards[largest].n
                        yield shards.pop(largest).row(number, largest)
                        number += 1
        for lang, own in shards.items():
            yield own.row(number, lang)
            number += 1

    return cut


class Bitmaps:
    """Position bitmaps of the words 1, 2, ... of `codes`; 0 is a position without a word."""

    def __init__(self, codes: np.ndarray) -> None:
        self.words = int(codes.max(initial=0)) + 1
        at = np.flatnonzero(codes)
        at = at[np.argsort(at // WIDTH * self.words + codes[at], kind="stable")]
        place = at // WIDTH * self.words + codes[at]
        starts = np.flatnonzero(np.diff(place, prepend=-1))
        self.key, self.word = place[starts] // self.words, place[starts] % self.words
        bits = np.left_shift(1, at % WIDTH).astype(np.uint16)
        self.bits = np.bitwise_or.reduceat(bits, starts) if len(starts) else bits
        self.ends = np.searchsorted(self.key, np.arange(len(codes) // WIDTH + 3))

    def batches(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word, key, bits) of whole words together that meet `most` bitmap words, or of one word."""
        order = np.argsort(self.word, kind="stable")
        meets = np.concatenate([[0], np.cumsum(self.ends[self.key[order] + 1] - self.ends[self.key[order]])])
        starts = np.append(np.flatnonzero(np.diff(self.word[order], prepend=-1)), len(order))
        i = 0
        while i < len(starts) - 1:
            j = max(i + 1, int(np.searchsorted(meets[starts], meets[starts[i]] + most, "right")) - 1)
            own = order[starts[i] : starts[j]]
            yield self.word[own], self.key[own], self.bits[own]
            i = j

    def grow(self, phrase: np.ndarray, key: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, next word, key, bits) of all phrases one word longer, of bitmaps with the phrases' last positions."""
        over = np.flatnonzero(bits >> np.uint16(WIDTH - 1))
        phrase, key = np.concatenate([phrase, phrase[over]]), np.concatenate([key, key[over] + 1])
        bits = np.concatenate([bits << np.uint16(1), np.ones(len(over), np.uint16)])
        n = self.ends[key + 1] - self.ends[key]
        mine = np.repeat(np.arange(len(key)), n)
        other = np.arange(len(mine)) - np.repeat(np.cumsum(n) - n - self.ends[key], n)
        both = bits[mine] & self.bits[other]
        hit = np.flatnonzero(both)
        mine = mine[hit]
        return phrase[mine], self.word[other[hit]], key[mine], both[hit]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chained(before: np.ndarray, gid: np.ndarray) -> np.ndarray:
    """The hash of a sequence from that of the sequence without its last number."""
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + gid)


def phrases(maps: Bitmaps, longest: int, gids: np.ndarray, allowed: Callable[[np.ndarray], np.ndarray] | None = None, most: int = MEETINGS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(words, hashes, counts) of the phrases of two words and more, of one length and a batch of first words each time; gids has the
    words' numbers. Only phrases all of whose pairs have a hash that is allowed grow and are given."""
    single = mixed(gids.astype(np.uint64))
    for phrase, key, bits in maps.batches(most):
        known, phrase = np.unique(phrase, return_inverse=True)
        words, hashes = known[:, None], single[known]
        for _ in range(2, longest + 1):
            phrase, word, key, bits = maps.grow(phrase, key, bits)
            if allowed is not None:
                there = np.flatnonzero(allowed(chained(single[words[phrase, -1]], gids[word].astype(np.uint64))))
                phrase, word, key, bits = phrase[there], word[there], key[there], bits[there]
            if not len(phrase):
                break
            found, phrase = np.unique(phrase * maps.words + word, return_inverse=True)
            before, last = found // maps.words, found % maps.words
            words, hashes = np.column_stack([words[before], last]), chained(hashes[before], gids[last].astype(np.uint64))
            yield words, hashes, np.bincount(phrase, weights=np.bitwise_count(bits)).astype(np.int64)


class Buckets:
    """2**bits buckets of 64-bit hashes, and the parts of PART buckets each that tasks add up."""

    def __init__(self, bits: int, part: int) -> None:
        self.bits, self.part, self.parts = bits, part, -(-(1 << bits) // part)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.bits)

    def edges(self, ascending: np.ndarray) -> Iterator[tuple[int, slice]]:
        ends = np.searchsorted(ascending // np.uint64(self.part), np.arange(self.parts + 1, dtype=np.uint64)).tolist()
        for p in range(self.parts):
            if ends[p] < ends[p + 1]:
                yield p, slice(ends[p], ends[p + 1])

    def sums(self, shard: int, hashes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Messages of a shard with its counts by bucket."""
        keys, at = np.unique(self.of(hashes), return_inverse=True)
        total = np.bincount(at, weights=counts, minlength=len(keys)).astype(np.int64)
        for p, own in self.edges(keys):
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([shard]), pa.array([B.pack_sorted(keys[own])], pa.binary()), pa.array([B.pack_ints(total[own])], pa.binary()), pa.nulls(1, pa.binary())], schema=SENT)

    def phrases(self, shard: int, gids: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Messages of a shard with its phrases, a row of numbers each (0: none), and their counts."""
        parts = self.of(hashes) // np.uint64(self.part)
        order = np.lexsort((*gids.T[::-1], parts))
        for p, own in self.edges(parts[order] * np.uint64(self.part)):
            at = order[own]
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([shard]), pa.nulls(1, pa.binary()), pa.array([B.pack_ints(counts[at])], pa.binary()), pa.array([pack_wide(gids[at].T)], pa.binary())], schema=SENT)

    def among(self, kept: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        """Whether hashes are in one of the buckets kept, ascending."""
        def test(hashes: np.ndarray) -> np.ndarray:
            buckets = self.of(hashes)
            return kept[np.minimum(np.searchsorted(kept, buckets), len(kept) - 1)] == buckets if len(kept) else np.zeros(len(buckets), bool)

        return test


def _frequent(least: int):
    def frequent(sent: pa.Table) -> pa.Table:
        """For each shard its buckets whose sum over all shards is `least` or more."""
        keys, counts = [B.unpack_sorted(x.as_py()) for x in sent.column("keys")], [B.unpack_ints(x.as_py()) for x in sent.column("n")]
        low = min(int(x[0]) for x in keys)
        at = [(x - np.uint64(low)).astype(np.int64) for x in keys]
        total = np.zeros(max(int(x[-1]) for x in at) + 1, np.int64)
        for x, n in zip(at, counts, strict=True):
            total[x] += n
        kept = [k[total[x] >= least] for k, x in zip(keys, at, strict=True)]
        rows = [(shard, B.pack_sorted(x)) for shard, x in zip(sent.column("shard").to_pylist(), kept, strict=True) if len(x)]
        return pa.table([pa.array([x for x, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], schema=KEPT)

    return frequent


def _summed(least: int):
    def summed(sent: pa.Table) -> pa.Table:
        """The phrases whose exact counts over all shards are `least` or more."""
        rows = np.concatenate([unpack_wide(x.as_py()).reshape(LONGEST, -1).T for x in sent.column("exact")])
        counts = np.concatenate([B.unpack_ints(x.as_py()) for x in sent.column("n")])
        known, at = np.unique(rows, axis=0, return_inverse=True)
        total = np.bincount(at.ravel(), weights=counts, minlength=len(known)).astype(np.int64)
        known, total = known[total >= least], total[total >= least]
        return pa.table([pa.array([[g for g in row if g] for row in known.tolist()], pa.list_(pa.int64())), pa.array(total)], schema=FOUND)

    return summed


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))
    return np.fromiter((xxhash.xxh3_64_intdigest(x, seed) for x in words), np.uint64, len(words))


def _send_words(buckets: Buckets):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, lang, ids, words in zip(*batch.columns, strict=True):
                units = B.unpack_units(words.as_py())[1:]
                counts = np.bincount(B.unpack_ints(ids.as_py()), minlength=len(units) + 1)[1:]
                yield from buckets.sums(shard.as_py(), _word_hashes(lang.as_py(), units), counts)

    return send


def _speak(buckets: Buckets):
    def speak(block: pa.Table, told: pa.Table) -> pa.Table:
        """A shard's words that are in buckets that its rows of `told` keep."""
        out = [SPOKEN.empty_table()]
        if block.num_rows and told.num_rows:
            row = block.to_pylist()[0]
            units = B.unpack_units(row["words"])
            hashes = _word_hashes(row["lang"], units[1:])
            codes = np.flatnonzero(buckets.among(_kept(told.column("kept")))(hashes)) + 1
            at = buckets.of(hashes[codes - 1])
            codes = codes[np.argsort(at, kind="stable")]
            counts = np.bincount(B.unpack_ints(row["ids"]), minlength=len(units))
            for p, own in buckets.edges(np.sort(at)):
                some = codes[own]
                out.append(pa.table([pa.array([p], pa.int32()), pa.array([row["shard"]]), pa.array([row["lang"]]), pa.array([B.pack_ints(some)], pa.binary()), pa.array([B.pack_units([units[i] for i in some.tolist()])], pa.binary()), pa.array([B.pack_ints(counts[some])], pa.binary())], schema=SPOKEN))
        return pa.concat_tables(out)

    return speak


def _name(least: int):
    def name(sent: pa.Table) -> pa.Table:
        """Numbers for the words whose counts over all shards are `least` or more, and for each shard its codes of them."""
        rows, total = sent.to_pylist(), {}
        for row in rows:
            row["units"] = B.unpack_units(row["words"])
            for word, n in zip(row["units"], B.unpack_ints(row["n"]).tolist(), strict=True):
                total[row["lang"], word] = total.get((row["lang"], word), 0) + n
        known = {key: (rows[0]["part"] << 32) + i for i, key in enumerate(sorted(key for key, n in total.items() if n >= least), 1)}
        out = []
        for row in rows:
            own = [known.get((row["lang"], word), 0) for word in row["units"]]
            gids = np.array(own, np.int64)
            if gids.any():
                out.append({"shard": row["shard"], "codes": B.pack_ints(B.unpack_ints(row["codes"])[gids > 0]), "gids": pack_wide(gids[gids > 0])})
        out += [{"gid": gid, "lang": lang, "word": word, "f": total[lang, word]} for (lang, word), gid in known.items()]
        return pa.Table.from_pylist(out, NAMED)

    return name


def _kept(column: pa.ChunkedArray) -> np.ndarray:
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(B.unpack_sorted(x) for x in column.to_pylist() if x)]))


def _maps(block: pa.Table, told: pa.Table) -> tuple[int, Bitmaps, np.ndarray] | None:
    """The shard, its bitmaps and the numbers of their words; None without frequent words."""
    own = [x for x in told.select(["codes", "gids"]).to_pylist() if x["codes"]]
    if not block.num_rows or not own:
        return None
    codes = np.concatenate([B.unpack_ints(x["codes"]) for x in own])
    gids = np.concatenate([unpack_wide(x["gids"]) for x in own])
    ids = B.unpack_ints(block.column("ids")[0].as_py())
    place = np.zeros(int(max(ids.max(), codes.max())) + 1, np.int64)
    place[codes] = np.arange(1, len(codes) + 1)
    return block.column("shard")[0].as_py(), Bitmaps(place[ids]), np.concatenate([[0], gids])


def _gathered(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], gids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers in LONGEST columns, hashes and counts of phrases of all lengths."""
    wide = [np.pad(gids[words], ((0, 0), (0, LONGEST - words.shape[1]))) for words, _, _ in found]
    none = np.zeros(0, np.int64)
    return np.concatenate([np.zeros((0, LONGEST), np.int64), *wide]), np.concatenate([none.astype(np.uint64), *(h for _, h, _ in found)]), np.concatenate([none, *(n for _, _, n in found)])


def _meet(buckets: Buckets, step: int):
    def meet(block: pa.Table, told: pa.Table) -> pa.Table:
        """step 2: sums of a shard's pairs; 3: its pairs in kept buckets and sums of longer phrases of such pairs; 4: its longer phrases in kept buckets."""
        out = []
        if made := _maps(block, told):
            shard, maps, gids = made
            if step == 2:
                found = list(phrases(maps, 2, gids))
                out += buckets.sums(shard, np.concatenate([h for _, h, _ in found]), np.concatenate([n for _, _, n in found])) if found else ()
            else:
                short, long = [], []
                fits = buckets.among(_kept(told.column("kept_longer"))) if step == 4 else None
                for words, hashes, n in phrases(maps, LONGEST, gids, buckets.among(_kept(told.column("kept")))):
                    if words.shape[1] == 2:
                        short.append((words, hashes, n))
                    elif fits is None:
                        long.append((words[:0], hashes, n))
                    else:
                        here = fits(hashes)
                        long.append((words[here], hashes[here], n[here]))
                if step == 3:
                    out += buckets.phrases(shard, *_gathered(short, gids))
                    out += buckets.sums(shard, np.concatenate([h for _, h, _ in long]), np.concatenate([n for _, _, n in long])) if long else ()
                else:
                    out += buckets.phrases(shard, *_gathered(long, gids))
        return pa.Table.from_batches(out, SENT)

    return meet


def count_phrases(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, phrases, totals): words (gid, lang, word, f) and phrases (g array<bigint>, f) of at least `least` occurrences, stored;
    totals (lang, n)."""
    small_batches(docs.sparkSession)
    rows = rows_of(docs, lang=F.coalesce(F.col("lang"), F.lit("und")), text=F.col("text").cast("binary"))
    shards = bucketed_table(rows.mapInArrow(lean(_to_shards(SHARD)), SHARDS), "phrase_shards", "shard")
    n = shards.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = Buckets(max(8, (n // BUCKET_WORDS).bit_length()), PART)
    keep = lambda sent: sent.select("part", "shard", "keys", "n").groupBy("part").applyInArrow(lean_table(_frequent(least)), ddl(KEPT))
    meet = lambda told, step: shards.select("shard", "ids").groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(lean_pair(_meet(buckets, step)), ddl(SENT))
    kept = keep(shards.select("shard", "lang", "ids", "words").mapInArrow(lean(_send_words(buckets)), ddl(SENT)))
    spoken = shards.drop("n").groupBy("shard").cogroup(kept.groupBy("shard")).applyInArrow(lean_pair(_speak(buckets)), ddl(SPOKEN))
    named = stage_table(spoken.groupBy("part").applyInArrow(lean_table(_name(least)), ddl(NAMED)), "phrase-words")
    codes = named.where("shard IS NOT NULL").select("shard", "codes", "gids")
    pairs = stage_table(keep(meet(codes, 2)), "phrase-pairs")
    told = codes.unionByName(pairs, allowMissingColumns=True)
    sent = stage_table(meet(told, 3), "phrase-sent")
    longer = keep(sent.where("keys IS NOT NULL")).withColumnRenamed("kept", "kept_longer")
    exact = sent.where("exact IS NOT NULL").unionByName(meet(told.unionByName(longer, allowMissingColumns=True), 4))
    found = stage_table(exact.select("part", "n", "exact").groupBy("part").applyInArrow(lean_table(_summed(least)), ddl(FOUND)), "phrase-counts")
    return named.where("gid IS NOT NULL").select("gid", "lang", "word", "f"), found, shards.groupBy("lang").agg(F.sum("n").alias("n"))


def _whole(column: str) -> Column:
    return F.col(column).cast("decimal(18,0)")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language of docs (text, lang).

    A null lang is `und`; null and empty texts have no words and a language without words has no rows. Texts of any length are read whole;
    repeated rows count as often as they stand there; columns but text and lang stay behind. Of cuts with one score the
    earliest counts; phrases of one score and a go by their bytes. An empty table gives an empty result.
    """
    words, found, totals = count_phrases(docs, least)
    # files are a tenth of their rows in memory or less; by their size the planner would broadcast these tables, and the driver hold them
    grown = lambda table: table.hint("merge")
    counts = found.unionByName(words.select(F.array("gid").alias("g"), "f"))
    named = found.select("g", F.posexplode("g").alias("i", "gid")).join(grown(words), "gid").groupBy("g").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("i", F.col("word").cast("string").alias("word")))).alias("at"))
    named = named.select("g", "lang", F.concat_ws(" ", F.col("at.word")).alias("phrase"))
    inside = found.where(F.size("g") > 2).select(F.col("f").alias("longer"), F.explode(F.expr(
        "flatten(transform(sequence(2, size(g) - 1), k -> transform(sequence(1, size(g) - k + 1), i -> slice(g, i, k))))")).alias("g"))
    covered = inside.groupBy("g").agg(F.max("longer").alias("longer"))
    kept = found.join(grown(covered), "g", "left").where("longer IS NULL OR longer < f").select("g", F.col("f").alias("a")).join(grown(named), "g").join(totals, "lang")
    cuts = kept.withColumn("k", F.explode(F.expr("sequence(1, size(g) - 1)"))).withColumns({"first": F.expr("slice(g, 1, k)"), "rest": F.expr("slice(g, k + 1, size(g) - k)")})
    cuts = cuts.join(grown(counts.select(F.col("g").alias("first"), F.col("f").alias("l"))), "first").join(grown(counts.select(F.col("g").alias("rest"), F.col("f").alias("r"))), "rest")
    cuts = cuts.withColumns({"over": F.lit(1000).cast("decimal(4,0)") * _whole("a") * _whole("n"), "under": _whole("l") * _whole("r")}).withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).orderBy(*order)
    ahead = best.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

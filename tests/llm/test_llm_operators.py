"""Operators against brute force on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from termlake.llm import ann, bpe_codec, exact_dedup, language_id, lm_scoring, near_dedup, sharding, token_files, toxicity

TEXTS = ["a b", "a  b", "a\tb", None, "", "  ", "c d e f g h i j k l", "don't stop, we're 123 45abc!", "x" * 3000, "日本語 テキスト", "'s 't \n\n z", "c d e f g h i j k l", "ﬁn Σας"]
SCHEMA = "doc_id bigint, text string, lang string, source string, digest string, n bigint, block string, slot string, size string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", "d", 1, "b", "s", "z") for i, t in enumerate(TEXTS)] + [(1, "a  b", "en", "s", "d", 1, "b", "s", "z"), (None, "nobody's", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 2)), lambda t: F.unhex(F.lit("00"))])
def test_exact(docs, none, digest):
    ids = {}
    counts = Counter(squeezed(r["text"]) for r in docs.collect())
    for r in docs.collect():
        if r["doc_id"] is not None:
            ids[squeezed(r["text"])] = min(ids.get(squeezed(r["text"]), 99), r["doc_id"])
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in counts}
    out = exact_dedup.exact_duplicates(docs, digest).collect()
    assert len(out) == docs.count()
    for r in out:
        text = by_sha[r["text_sha256"]]
        assert (r["keep_id"], r["group_size"]) == (ids.get(text), counts[text])
        assert r["kept"] == (r["doc_id"] == r["keep_id"])
    assert exact_dedup.exact_duplicates(none, digest).count() == 0


@pytest.mark.parametrize(("memtable", "fanout"), [(1, 2), (5, 2), (40, 8), (1000, 8)])
def test_merge_index(spark, tmp_path, memtable, fanout):
    rows = [(i if i % 9 else None, hashlib.md5(str(i % 17 if i % 3 else i).encode()).digest()) for i in range(200)]
    index = exact_dedup.MergeIndex(spark, f"file://{tmp_path}/index", memtable, fanout)
    index.flush(spark.createDataFrame(rows, "doc_id bigint, digest binary"))
    assert index.number() == -(-200 // memtable)
    merged = index.compact().collect()
    assert index.number() == 1 and fanout**index.level >= -(-200 // memtable) > fanout ** (index.level - 1)
    ids = {}
    for i, digest in rows:
        ids.setdefault(digest, []).append(i)
    assert {(bytes(r["digest"]), r["keep_id"], r["n"]) for r in merged} == {(d, min((x for x in own if x is not None), default=None), len(own)) for d, own in ids.items()}
    assert len(merged) == len(ids)


def test_bpe(docs, none):
    ranks = bpe_codec.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r["doc_id"], tuple(whole.encode_ordinary(r["text"] or "")), (r["text"] or "").encode()) for r in docs.collect())
    out = bpe_codec.decode(bpe_codec.encode(docs, ranks, public_tokenizers.PATTERN), ranks).collect()
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), bytes(r["decoded"])) for r in out) == want
    assert bpe_codec.encode(none, ranks, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError, match="pattern"):
        bpe_codec.encode(docs, ranks, r"\S+|\s+")
    ids = docs.sparkSession.createDataFrame([(1, None), (2, b""), (3, (72).to_bytes(4, "little"))], "doc_id bigint, ids binary")
    table = bpe_codec.token_table(ranks)
    assert [r["decoded"] for r in bpe_codec.decode(ids, ranks).orderBy("doc_id").collect()] == [None, b"", table[72]]


def test_token_files(docs, none):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    library = Tokenizer.from_str(vocabulary)
    out = token_files.read_tokens(token_files.write_tokens(docs, vocabulary, 1)).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == sorted([r["doc_id"] for r in out], key=lambda x: (x is not None, x or 0))
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in out) == Counter((r["doc_id"], (*library.encode(r["text"] or "", add_special_tokens=False).ids, 1)) for r in docs.collect())
    at = 0
    for r in out:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(r["ids"]) // 4, zlib.crc32(r["ids"]))
        at += r["n_tokens"]
    assert token_files.read_tokens(token_files.write_tokens(none, vocabulary, 1)).count() == 0


@pytest.mark.parametrize("text", ["x <| y USA Hello, Sam", "a <|endoftext|> B Hello!", "a<|startoftext|>B", "f <|ENDOFTEXT|> USA Émile", "<|USER|> Hello <|end", "USA"])
def test_token_ids_with_special_tokens(text):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    ids = token_files.WordEncoder(vocabulary, 2).encode(["Hello, USA".encode(), text.encode(), b""])
    library = Tokenizer.from_str(vocabulary)
    assert [np.frombuffer(x, "<u2").tolist() for x in ids] == [library.encode(x, add_special_tokens=False).ids for x in ("Hello, USA", text, "")]


def test_token_ids_of_random_texts():
    """Against the library: capitals, marks, numbers, special tokens, all kinds of space, marks that combine."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    library, encoder = Tokenizer.from_str(vocabulary), token_files.WordEncoder(vocabulary, 2)
    random = np.random.default_rng(11)
    pieces = ["the", "Cat", "USA", "naïve", "É", "e\u0301", "don't", "o'clock,", "x_y", "--", "...", "!?", "42", "3.5", "<|endoftext|>", "<|", "|>", "日本", "ﬁn", "Σας", "İ", "ß", "\u0301", "emoji😀", "A.B", "ZZZ.", "zzz,", "'s", "'S"]
    gaps = [" ", "", "\t", "\n ", "\x0b", "\xa0", "\u2003", "\u3000", "\x85", "\x1c"]
    for _ in range(60):
        texts = ["".join(str(x) for _ in range(int(random.integers(0, 30))) for x in (random.choice(pieces), random.choice(gaps))) for _ in range(50)]
        want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode([t.encode() for t in texts])] == want


@pytest.mark.parametrize("values", [[], [1], [0, 0, 0], [3, 3, 90, 1000, 1000, 70_000], list(range(0, 9000, 7)), [5] * 700 + [1 << 40] * 300, [0, (1 << 63) + 5]])
def test_elias_fano(values):
    coded = token_files.EliasFano.load(token_files.EliasFano.of(np.array(values, np.uint64)).dump())
    assert coded.range(0, len(values)).tolist() == values
    assert [coded.select(i) for i in range(len(values))] == values
    assert all(coded.range(a, min(a + 300, len(values))).tolist() == values[a : a + 300] for a in range(0, len(values), 77))
    # near-minimal: two bits and the low ones a value, an eighth of a bit for select, and the head
    assert 8 * len(coded.dump()) <= len(values) * (coded.low_bits + 3.2) + 8 * 50
    with pytest.raises(IndexError):
        coded.select(len(values))


@pytest.mark.parametrize("names", [[None, None], [None, -5, -5, 0, 9], [-(1 << 63), (1 << 63) - 1], [7]])
def test_segment(names):
    ids = np.arange(2 * len(names), dtype="<u2")
    segment = token_files.Segment(token_files.write_segment(names, np.arange(1, len(names) + 1) * 2, ids.tobytes(), 2))
    assert segment.doc_ids(0, len(names)) == names
    assert [segment.doc_ids(i, i + 1)[0] for i in range(len(names))] == names
    assert [segment.bounds(i, i + 1).tolist() for i in range(len(names))] == [[2 * i, 2 * i + 2] for i in range(len(names))]


def test_read_document(spark, docs):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    manifest = token_files.write_tokens(docs, vocabulary, 1)
    rows = token_files.read_tokens(manifest).orderBy("start").collect()
    for place in (0, 5, len(rows) - 1):
        assert token_files.read_document(manifest, place).astype("<u4").tobytes() == bytes(rows[place]["ids"])
    with pytest.raises(IndexError):
        token_files.read_document(manifest, len(rows))


def test_shards(docs, none, spark, tmp_path):
    out = sharding.shard_documents(docs, 4).collect()
    for shard in range(4):
        own = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert own == list(range(len(own)))
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("text"))
    path = f"file://{tmp_path}/map"
    sizes = [r["s"] for r in sharding.shard_documents(many, 16, path).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 91 * 3
    records = sharding.with_slots(many.select("doc_id", sharding.text_bytes(F.col("text")).alias("size"), F.crc32("text").alias("text_crc32"), F.col("doc_id").alias("row")))
    before, after = (r.select("virtual_slot", "shard") for r in (sharding.read_map(spark, path, 1), sharding.rebalance(records, path, 1, 17)))
    moved = before.toDF("virtual_slot", "was").join(after, "virtual_slot").where("was <> shard").count()
    assert 0 < moved < 0.2 * before.count()
    assert sharding.shard_documents(none, 4).count() == 0


def test_shards_of_records_without_ids(spark):
    """Half of the rows have no id, a fifth one id, a fifth are one row again and again."""
    rows = [(None, "x" * (i % 61), None, None, None, None, None, None, None) for i in range(8000)] + [(7, "y" * (i % 67), *[None] * 7) for i in range(3000)] + [(8, "z" * 30, *[None] * 7)] * 3000 + [(100 + i, "w" * (i % 50), *[None] * 7) for i in range(2000)]
    out = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA).repartition(4), 16).collect()
    assert len(out) == len(rows)
    sizes = [sum(r["size"] for r in out if r["shard"] == x) for x in range(16)]
    assert max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 16
    for x in range(16):
        own = sorted(r["slot"] for r in out if r["shard"] == x)
        assert own == list(range(len(own)))


def test_shards_against_brute_force(spark, docs, none):
    rows = docs.union(spark.createDataFrame([(77, "é" * 100_000, "en", "s", "d", 1, "b", "s", "z")], SCHEMA))
    out = sharding.shard_documents(rows, 4).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    # largest slots first, each to the lightest shard
    slots, where = Counter(), {}
    for r in out:
        slots[r["virtual_slot"]] += r["size"]
        where.setdefault(r["virtual_slot"], set()).add(r["shard"])
    loads, picks = [0] * 4, {}
    for slot, size in sorted(slots.items(), key=lambda x: (-x[1], x[0])):
        picks[slot] = loads.index(min(loads))
        loads[picks[slot]] += size
    assert where == {slot: {shard} for slot, shard in picks.items()}
    for shard in range(4):
        own = sorted((r["slot"], r["virtual_slot"]) for r in out if r["shard"] == shard)
        assert [x for x, _ in own] == list(range(len(own))) and [x for _, x in own] == sorted(x for _, x in own)


def test_near(spark, docs, none):
    words = [f"w{i}" for i in range(200)]
    near = [*words[:100], "odd", *words[101:]]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words).upper()), (4, " ".join(words[:60] + [f"z{i}" for i in range(140)])), (5, None), (6, ""), (7, "short"), (8, "short"), (None, "short")]
    out = {r["doc_id"]: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {i: out[i]["class_id"] for i in out} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7, None: None}
    assert near_dedup.near_duplicates(docs).count() == docs.count()
    assert near_dedup.near_duplicates(none).count() == 0


def shingle_weights(texts):
    """Count times IDF of the five-word shingles of each text, by the definition."""
    words = [t.lower().split() for t in texts]
    sets = [Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(1, len(w))))) for w in words]
    total, frequency = sum(1 for s in sets if s), Counter(g for s in sets for g in s)
    return [{g: n * (near_dedup.FLOOR + (1 - near_dedup.FLOOR) * np.log(total / frequency[g]) / np.log(total)) for g, n in s.items()} for s in sets]


@pytest.mark.parametrize("small", [8, 2])
def test_near_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "TOGETHER", 500)
    monkeypatch.setattr(near_dedup, "PART_SHINGLES", 2000)
    random = np.random.default_rng(5)
    word = lambda: "".join(random.choice(list("abcdefgh"), 6))
    rows = [(7, "the very same long text of many words", "x")]
    for group in range(12):
        base = [word() for _ in range(int(random.integers(30, 160)))]
        base += base[:20] * (group % 3)  # shingles that occur twice
        for _ in range((3, 40)[group % 6 == 0]):
            edited = list(base)
            for place in random.integers(0, len(base), int(random.integers(0, 5))):
                edited[place] = word()
            rows.append((len(rows) + 100, " ".join(edited), "x"))
    rows += [(len(rows) + 200, rows[1][1].upper(), None), (7, "other words under an id that occurs twice", "x")]
    weights = shingle_weights([r[1] for r in rows])
    above = lambda a, b: sum(min(v, b.get(g, 0)) for g, v in a.items()) / sum(max(a.get(g, 0), b.get(g, 0)) for g in a.keys() | b.keys()) >= near_dedup.SIMILAR
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and above(weights[i], weights[j]):
                label = [label[j] if x == label[i] else x for x in label]
    want = Counter((rows[i][0], min(r[0] for r, x in zip(rows, label, strict=True) if x == label[i]), label.count(label[i])) for i in range(len(rows)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, digest string").repartition(5)
    out = near_dedup.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in out) == want
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in out)


def test_language_model(docs, none):
    out = lm_scoring.score_documents(docs, F.coalesce(F.col("doc_id") == 7, F.lit(False))).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    seen = Counter(w for r in docs.collect() if r["doc_id"] != 7 for w in tokens(r["text"]))
    n = sum(seen.values())
    want = Counter((r["doc_id"], len(tokens(r["text"])), sum(w in seen for w in tokens(r["text"])), round(sum(np.log10((seen[w] + 1) / (n + len(seen) + 1)) for w in tokens(r["text"])), 6)) for r in docs.collect())
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in out) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in out)
    assert lm_scoring.score_documents(none, F.lit(False)).count() == 0


def test_language_model_score_against_brute_force(spark):
    """The mixture by its definition: deleted estimates in bins, weights by expectation-maximisation, probabilities of whole texts."""
    random = np.random.default_rng(4)
    vocabulary = ["alpha", "beta", "gamma", "delta", "rare", "once"]
    rows = [(i, " ".join(random.choice(vocabulary, int(random.integers(0, 25)), p=[0.4, 0.25, 0.2, 0.1, 0.04, 0.01]))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    out = {r["doc_id"]: r["score"] for r in lm_scoring.score_documents(docs, F.col("doc_id") % 5 == 0).collect()}
    stream = [(i, w) for i, text in rows for w in [*text.split(), ""]]
    train = [i % 5 != 0 for i, _ in stream]
    before = ["", *[w for _, w in stream[:-1]]]
    words = Counter(w for (_, w), t in zip(stream, train, strict=True) if t)
    pairs = Counter((b, w) for b, (_, w), t in zip(before, stream, train, strict=True) if t)
    n, distinct = sum(words.values()), len(words)
    bucket = lambda c: 1 + int(np.floor(np.log2(c))) if c > 0 else 0
    fine = lambda p: min(1 + int(np.floor(-4 * np.log2(p))), 255) if p > 0 else 0
    middle = lambda b: 2.0 ** (-(b - 0.5) / 4) if b else 0.0
    held = Counter()
    for b, (_, w), t in zip(before, stream, train, strict=True):
        if t:
            c, q = words[b] - 1, pairs[b, w] - 1
            held[bucket(c), fine(q / c if c > 0 else 0), fine((words[w] - 1) / (n - 1))] += 1
    weights = {}
    for own in sorted({k for k, _, _ in held}):
        mix = np.array([0.4 * (own > 0), 0.4, 0.2])
        for _ in range(lm_scoring.EM_STEPS):
            total = np.zeros(3)
            for (k, a, b), count in held.items():
                if k == own:
                    share = mix * np.array([middle(a), middle(b), 1 / (distinct + 1)])
                    total += count * share / share.sum()
            mix = total / total.sum()
        mix = np.maximum(mix, 1e-6 * np.array([own > 0, 1, 1]))
        weights[own] = mix / mix.sum()
    for own in range(64):
        weights.setdefault(own, weights[own - 1] if own > 1 else np.array([0.0, 0.9, 0.1]))
    want = Counter()
    for b, (i, w) in zip(before, stream, strict=True):
        mix, c = weights[bucket(words[b])], words[b]
        want[i] += np.log10(mix[0] * (pairs[b, w] / c if c else 0) + mix[1] * words[w] / n + mix[2] / (distinct + 1))
    assert all(abs(want[i] - out[i]) < 1e-6 for i, _ in rows)


def test_language_against_brute_force(spark):
    """Triples bound and bundled one by one, cosines with each profile."""
    random = np.random.default_rng(6)
    alphabets = {"aa": "abcdefg é", "bb": "fghijkl ñ", "cc": "mnopqrs日本"}
    texts = [("".join(random.choice(list(alphabets[lang]), int(random.integers(1, 60)))), lang) for lang in alphabets for _ in range(30)]
    texts += [("x" * 300_000 + " abc", "aa"), ("12 !", "bb"), ("", "bb"), (None, "aa"), ("😀a", None), ("Ab Ab", None)]
    rows = spark.createDataFrame([(t, x, "s", 1.0) for t, x in texts], "text string, lang string, lang_ string, n double")
    first, second, third = (x.astype(np.int64) for x in language_id._vectors(language_id.DIM))

    def bundle(text):
        letters = [1 + ord(c) % 1023 if c.isalpha() else 0 for c in (text or "").lower()]
        padded = [0, *letters, 0]
        padded = [c for i, c in enumerate(padded) if i == 0 or c or padded[i - 1]]
        counted = Counter(zip(padded, padded[1:], padded[2:], strict=False))
        return sum((n * first[a] * second[b] * third[c] for (a, b, c), n in counted.items()), np.zeros(language_id.DIM)), bool(counted)

    profiles = {}
    for text, lang in texts:
        if text is not None and lang is not None:
            profiles[lang] = profiles.get(lang, 0) + bundle(text)[0]
    found = language_id.identify(rows, language_id.learn_profiles(rows)).collect()
    for r in found:
        vector, any_ = bundle(r["text"])
        cosines = {x: float(vector @ p) / (np.linalg.norm(vector) * np.linalg.norm(p) or 1) for x, p in profiles.items()}
        best = max(cosines.values())
        assert r["lang_pred"] == "und" if not any_ else abs(cosines[r["lang_pred"]] - best) < 1e-5
        assert abs(r["score"] - (min(max(best, 0), 1) if any_ else 0)) < 1e-5


def test_language(spark, docs, none):
    rows = [("the cat and the dog are in the house", "en"), ("le chat et le chien sont dans la maison", "fr"), (None, "en"), ("x", None)] * 5
    profiles = language_id.learn_profiles(spark.createDataFrame(rows, "text string, lang string"))
    assert sorted(profiles) == ["en", "fr"]
    asked = spark.createDataFrame([("the house and the cat",), ("la maison et le chat",), (None,), ("12 !",)], "text string")
    assert [r["lang_pred"] for r in language_id.identify(asked, profiles).collect()] == ["en", "fr", "und", "und"]
    assert language_id.identify_documents(docs, F.lit(True)).count() == docs.count()
    assert language_id.identify_documents(none, F.lit(True)).count() == 0


def test_toxicity(spark, docs, none):
    toxic = [(f"you {w} idiot muslims here", 1) for w in "abcdefghij"]
    clean = [(f"some {w} calm words here", 0) for w in "abcdefghij"]
    fair, plain = toxicity.train(toxic + clean, gamma=5.0), toxicity.train(toxic + clean, gamma=0.0)
    gap = lambda m: abs(m.score("muslims live here") - m.score("christians live here"))
    assert gap(fair) < gap(plain)
    assert fair.score("you idiot") > 0.5 > fair.score("calm words")
    assert toxicity.score_texts(docs, fair).count() == docs.count()
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r["score"] for r in toxicity.score_documents(docs, labels, F.lit(True)).collect()} == {0.5}
    assert toxicity.score_documents(none, labels, F.lit(True)).count() == 0


def test_toxicity_in_tasks_as_in_memory(spark):
    """The distributed training gives the model of the one in memory, and scores in tasks are those by the definition."""
    random = np.random.default_rng(2)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(5)]
    rows = []
    for i in range(160):
        toxic = i % 4 == 0
        text = " ".join(random.choice(words, 12)) + (" idiot muslims. calm women" if toxic else " friends. " + str(random.choice(["muslims", "jews", "men", "x"])))
        rows.append((i, text, int(toxic)))
    docs = spark.createDataFrame([(i, text, "c", 1.0) for i, text, _ in rows] + [(None, None, "c", 1.0), (3, "x " * 200_000 + "idiot", "c", 1.0)], "doc_id bigint, text string, lang string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i != 3], "doc_id bigint, toxic int")
    taken = toxicity.sample(docs, labels, F.lit(True))
    assert len(taken) == 159
    here, there = toxicity.train(sorted(taken)), toxicity.learn(toxicity.sampled(docs, labels, F.lit(True)))
    assert here.weights.keys() == there.weights.keys() and abs(here.bias - there.bias) < 1e-6
    assert all(abs(w - there.weights[f]) < 1e-6 for f, w in here.weights.items())
    scored = toxicity.score_documents(docs, labels, F.lit(True)).collect()
    assert Counter((r["doc_id"], round(r["score"], 6)) for r in scored) == Counter((r["doc_id"], round(there.score(r["text"] or ""), 6)) for r in docs.collect())
    flips = lambda m: np.mean([m.score(f"{a} live here") >= 0.5 for group in toxicity.IDENTITIES for a in group])
    plain = toxicity.learn(toxicity.sampled(docs, labels, F.lit(True)), gamma=0.0)
    assert flips(there) <= flips(plain)
    # every other term of a list is tried, each once
    pairs = list(toxicity.counterfactuals("The muslims live. Women too."))
    swapped = {frozenset(b - a) for a, b in pairs}
    assert len(pairs) == 5 + 1 and all(any(t in x for x in swapped) for t in ("christians", "jews", "hindus", "buddhists", "atheists", "men"))


def test_toxicity_sample_passes_over_giants(spark):
    order = sorted(range(20), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    texts = {i: "x" * (500 if at in (0, 7) else 60 if at == 4 else 10) for at, i in enumerate(order)}
    rows = [*texts.items(), (order[1], "y" * 700)]
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(i, i % 2) for i in texts], "doc_id bigint, toxic int")
    for most, size in ((20, 100), (5, 100), (20, 115), (20, 5), (20, 10_000)):
        want, left, n = [], size, most
        for i, text in sorted(rows, key=lambda r: (order.index(r[0]), len(r[1]))):
            if n and len(text) <= left:
                want.append((text, i % 2))
                left, n = left - len(text), n - 1
        assert Counter(toxicity.sample(docs, labels, F.lit(True), most, size)) == Counter(want)


@pytest.mark.parametrize("shard", [4096, 150])
def test_nearest(spark, shard):
    random = np.random.default_rng(3)
    vectors = random.normal(size=(600, 16))
    scale = np.ones(600)
    scale[[50, 51]], scale[[100, 101]] = 1e200, 1e-200  # squares leave the range of doubles
    rows = [(i, [float(x) for x in v * s], "t", 1) for i, (v, s) in enumerate(zip(vectors, scale, strict=True))]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [float(x) for x in vectors[0]]), (905, [float("inf")] * 16), (950, [1.0, 2.0]), (None, [1.0] * 16)]
    docs = spark.createDataFrame([(*r, "t", 1)[:4] for r in rows], "vec_id bigint, embedding array<double>, shard string, rank int")
    found = ann.search_embeddings(docs, F.col("vec_id") % 50 == 0, 5, shard=shard).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 600, 50):
        scores = unit @ unit[q]
        scores[q] = -2
        own = {r["vec_id"]: r["score"] for r in found if r["query_id"] == q}
        hits += len(set(np.argsort(-scores)[:5].tolist()) & own.keys())
        assert len(own) == 5 and all(abs(s - scores[i]) < 1e-12 for i, s in own.items() if i < 600)
    assert hits >= 0.9 * 12 * 5
    assert next(r["vec_id"] for r in found if r["query_id"] == 0 and r["rank"] == 1) == 904
    assert not {900, 901, 902, 903, 905, 950} & {r["query_id"] for r in found}
    assert ann.search_embeddings(docs.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0

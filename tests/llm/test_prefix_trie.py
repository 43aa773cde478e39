"""The trie of rebuilt conversations against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from termlake.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string, depth string, n string"


def brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            convs[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    convs = {c: [x[1:] for x in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        rebuilt[c] = convs.get(base, [])[:h] + own[h:]
    nodes = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for key in nodes:
        if key:
            children[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[key]) - 1) * len(re.findall(r"[^\x20\x09-\x0d]+", key[-1][1])) if key else 0
        leaves[key] = sum(leaves[x] for x in children[key]) or 1
        saved[key] = own + sum(saved[x] for x in children[key])
    return sorted(
        (min(c), len(key), min(nodes[key[:-1]]) if key else -1, len(c), len(children[key]), leaves[key], saved[key],
         hashlib.sha256(",".join(str(x) for x in sorted(c) if len(rebuilt[x]) == len(key)).encode()).hexdigest())
        for key, c in nodes.items()
    )


def found(spark, rows, parts):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    out = [tuple(r) for r in prefix_trie.prefix_trie(df).collect()]
    return sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in out)


def rows_of(seed, convs, deep):
    rnd, rows = random.Random(seed), []
    for c in rnd.sample(range(-30, 130), convs):
        kind = rnd.randrange(4)
        for t in range(rnd.randrange(1, 7)):
            text = rnd.choice(["hello", "a b", None, "", "x\ty  z", "ü", "y" * 700]) if kind else f"common {t}"
            rows.append((c, rnd.choice([t, t, None, 3]) if kind == 1 else t, rnd.choice(["user", "assistant", None]) if kind else "user", text, "k", "d", "n"))
    rows += [(500, t, "user", "again and again", "k", "d", "n") for t in range(deep)] + [(520 + i, t, "user", "again and again", None, None, None) for i in range(8) for t in range(9)]
    return [*rows, *rows[:4], (None, 1, "user", "of nobody", None, None, None)]


@pytest.mark.parametrize(("seed", "convs", "deep", "parts"), [(1, 60, 90, 3), (2, 100, 10, 1)])
def test_trie(spark, seed, convs, deep, parts):
    rows = rows_of(seed, convs, deep)
    assert found(spark, rows, parts) == brute(rows)


def test_conversations_cut_by_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        rows = rows_of(3, 20, 60)
        assert found(spark, rows, 2) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table(spark):
    assert found(spark, [], 1) == []


def test_ids_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 20)
    rows = [(c, 0, "user", "same", None, None, None) for c in range(0, 2000, 20)] + [(c, 0, "user", f"own {c % 40}", None, None, None) for c in range(1, 2000, 20)]
    assert found(spark, rows, 2) == brute(rows)

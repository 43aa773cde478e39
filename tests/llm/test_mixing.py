"""Targets against resharing step by step; the mix against its definition."""

from pyspark.sql import functions as F

from termlake.llm import mixing


def reshared(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    out, full, left = dict.fromkeys(names, 0.0), set(), share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        if not rest:
            return out
        for s in rest:
            out[s] = left * weight[s] / sum(weight[r] for r in rest)
        above = {s for s in rest if out[s] > most * sizes[s]}
        if not above:
            return out
        for s in above:
            out[s] = most * sizes[s]
            left -= out[s]
        full |= above


def test_targets(spark):
    for sizes in ({"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 900, "c": 5, None: 300}, {"x": 0, "y": 50}, {f"s{i}": 50 + 7 * i for i in range(20)}, {"a": 3}):
        rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()
        want = reshared(sizes)
        assert {r["source"]: round(r["target"], 6) for r in rows} == {s: round(x, 6) for s, x in want.items()}


def test_mix(spark):
    rows = [(i, f"s{i % 4}" if i % 4 else None, "w " * (i % 13) if i % 11 else None, 1) for i in range(400)] + [(7, "s3", "a b c", 2), (7, "s3", "a b c", 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, size int")
    out = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r["doc_id"], r["size"], r["taken"])
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert len(out) == len(rows)
    by = {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    for own in by.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert len({r["copies"] for r in own if r["size"]}) <= 2
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.where("doc_id = 5").count() == next(r["copies"] for r in out if r["doc_id"] == 5)


def test_small_shares_go_first(spark):
    rows = [(i, "a", " ".join("x" * 4 for _ in range(10))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    out = mixing.mix(docs)
    assert {r["copies"]: r["n"] for r in out.groupBy("copies").agg(F.count("*").alias("n")).collect()} == {1: 20, 2: 20}


def test_mixed_documents_with_clashing_columns(spark):
    rows = [(1, "a", "x y z", 7, "m", "k"), (1, "a", "x y z", 7, "m", "k"), (2, None, None, 7, "m", "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, copies int, mix_id string, key string")
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert {tuple(r) for r in mixed.collect()} <= set(rows) and mixed.count() >= 3


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, source string, text string")
    assert mixing.mix(docs).count() == 0

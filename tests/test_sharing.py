"""Passages near to a question among those that share a concept with it: exact, with each vector stored once."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from termlake.functions import text as T
from termlake.operators import resolution, sharing, similarity, vector_index
from termlake.plans import flows


def nearest(asked, wanted, rows, k):
    best = []
    for q in sorted({q for q, _ in asked}):
        see, near = {c for x, c in wanted if x == q}, {}
        for v in (v for x, v in asked if x == q):
            for key, w, own in rows:
                if v and w and see & set(own):
                    distance = round(1 - float(similarity.rounded(np.array([np.dot(v, w)]), 6)[0]), 6)
                    near[key] = min(near.get(key, distance), distance)
        best += [(q, n, key, distance) for n, (distance, key) in enumerate(sorted((d, key) for key, d in near.items())[:k], 1)]
    return best


@pytest.mark.parametrize("round_bytes, piece", [(sharing.ROUND_BYTES, sharing.PIECE_ROWS), (3000, 50)])
def test_nearest_sharing(spark, monkeypatch, round_bytes, piece):
    """As all pairs say, in one round and in several: ties, rare and common concepts, keys of several rows, queries that find less than k."""
    monkeypatch.setattr(sharing, "PIECE_ROWS", piece)
    rnd = np.random.default_rng(7)
    some = lambda n: sorted({f"c{int(30 * rnd.random() ** 3)}" for _ in range(rnd.integers(1, n))})
    rows = [(f"k{i % 290:03}", rnd.normal(size=3).round(1).tolist(), some(6)) for i in range(300)] + [("z", None, ["c0"]), ("y", [9.0, 9.0, 9.0], [])]
    asked = [(f"q{i % 38}", (rnd.normal(size=3) * 10.0 ** rnd.integers(-7, 3)).round(7).tolist()) for i in range(40)] + [("none", [1.0, 0.0, 0.0]), ("blank", None)]
    wanted = [(q, c) for q in sorted({q for q, _ in asked} - {"none"}) for c in some(5)] + [("q1", "unknown")]
    made = lambda x, schema: spark.createDataFrame(x, schema).repartition(3)
    found = sharing.nearest_sharing(made(asked, "query_id string, vector array<double>"), made(wanted, "query_id string, concept string"), made(rows, "key string, vector array<double>, concepts array<string>"), 4, round_bytes)
    assert sorted(map(tuple, found.collect())) == nearest(asked, wanted, rows, 4)


def test_words_in_tasks():
    rnd = random.Random(5)
    marks = ["a", "B", "7", " ", "\n", "-", "é", "ß", "ﬁ", "½", "é", "Ω", "İ", "—", "𝐀", "\x1c", "\x85", "\xa0", " ", " ", "　", "​"]
    every = {"".join(x) for x in (("a",), ("b",), ("ab",), ("ss",), ("fi",), ("e",), ("7",), ("i",), ("ba",), ("ea",))}
    find = T.word_finder(every)
    for _ in range(2000):
        text = "".join(rnd.choices(marks, k=rnd.randrange(30)))
        assert find(text) == every.intersection("".join(map(T._folded, text)).split()), text
    assert all(T._folded(chr(c)) == " " for c in range(0x110000) if chr(c).isspace())


def test_passages_are_stored_once(spark, tmp_path, monkeypatch):
    """No table of vectors has more rows than there are documents or questions, however many words they share; results are the SQL's."""
    duckdb = pytest.importorskip("duckdb")
    rnd = random.Random(11)
    words = [a + b for a in ("pump", "filter", "vérin", "gas", "seal", "odd") for b in ("", "a", "s", "o", "x")]
    said = lambda n: " ".join(rnd.choices(words, k=n)).capitalize()
    documents = [(i, said(40) + "\n\tÉté — über.", rnd.choice(["en", "fr", None]), "s", 1) for i in range(60)] + [(60, None, "en", "s", 0), (61, "", "en", "s", 0), (62, "nothing", "en", "s", 7)]
    asked = [(i, j, "user" if j % 2 == 0 else "assistant", said(6) + " leftover thing?") for i in range(10) for j in range(4)]
    tables = {"documents": (documents, "doc_id bigint, text string, lang string, source string, n_chars bigint"), "conversations": (asked, "conv_id bigint, turn bigint, role string, text string"), "benchmark": ([(0, " ".join(words))], "item_id bigint, text string")}
    sql = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        sql.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet' WHERE text IS NOT NULL")
    sizes, stored = {}, flows.stage

    def spied(df, name):
        out = stored(df, name)
        if {"vector", "key"} <= set(out.columns) or {"vector", "doc_id"} <= set(out.columns):
            sizes[name] = out.count()
        return out

    for module in (flows, sharing, vector_index):
        monkeypatch.setattr(module, "stage", spied)
    found = flows.ask_passages(spark, str(tmp_path)).select("id", F.col("rank").cast("long"), "passage_id", "score")
    assert sorted(map(tuple, found.collect())) == sorted(sql.execute(flows.ASK_PASSAGES).fetchall())
    assert sizes and max(sizes.values()) <= 60


def test_only_phrases_that_a_look_can_reach_are_looked_up(spark, tmp_path, monkeypatch):
    """A question of a hundred words has twelve looks: what these find is what the SQL finds that tries all of its phrases, and few are stored."""
    duckdb = pytest.importorskip("duckdb")
    rnd = random.Random(13)
    words = ["pump", "filters", "verin", "gas", "seal", "odd", "ab"]
    other = ["the", "of", "process", "things", "zeal", "leftover", "Pumpe", "fitler", "vérins,", "(gsa)", "—", "xq", "thing", "seale"]
    said = lambda known, n: " ".join(rnd.choices(words, k=1)[0] if rnd.random() < known else rnd.choice(other) for _ in range(n))
    asked = [(i, 0, "user", said(rnd.choice((0.05, 0.2, 0.4)), rnd.choice((1, 3, 8, 30, 100)))) for i in range(60)] + [(60, 0, "user", ""), (61, 0, "user", " ".join(f"{a}{b}x" for a in "bcdfghjklm" for b in "npqrstvwxz"))]
    tables = {"documents": ([(i, said(0.5, 9), rnd.choice(["en", "fr", "de", None]), "s", 1) for i in range(30)], "doc_id bigint, text string, lang string, source string, n_chars bigint")}
    tables |= {"conversations": (asked, "conv_id bigint, turn bigint, role string, text string"), "benchmark": ([(0, " ".join(words))], "item_id bigint, text string")}
    sql = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        sql.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    spans, stored = {}, resolution.stage

    def spied(df, name):
        out = stored(df, name)
        if name == "spans":
            spans.update({r["id"]: r["count"] for r in out.groupBy("id").count().collect()})
        return out

    monkeypatch.setattr(resolution, "stage", spied)
    by = lambda rows: sorted((tuple(r) for r in rows), key=str)
    answer = flows.answer(spark, str(tmp_path))
    monkeypatch.setattr(flows, "answer", lambda *_: answer)
    assert by(flows.ask_second_pass(spark, str(tmp_path)).collect()) == by(sql.execute(flows.ASK_SECOND).fetchall())
    assert by(flows.ask_disagreements(spark, str(tmp_path)).collect()) == by(sql.execute(flows.ASK_DISAGREE).fetchall())
    assert spans["61:0"] == 45

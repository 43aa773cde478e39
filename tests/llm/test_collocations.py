"""Phrases against brute force, over one shard and many."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from termlake.llm import collocations

SCHEMA = "doc_id bigint, text string, lang string, word string, n bigint, shard bigint"


def brute(rows, least, top):
    counts, totals, out = defaultdict(Counter), Counter(), []
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    for lang, found in counts.items():
        best = []
        for phrase, a in found.items():
            k, n = len(phrase), totals[lang]
            if k < 2 or a < least:
                continue
            if any(len(x) > k and f >= least and 100 * f >= 100 * a and any(x[i : i + k] == phrase for i in range(len(x) - k + 1)) for x, f in found.items()):
                continue
            score, cut = min((1000 * a * n // (found[phrase[:i]] * found[phrase[i:]]), i) for i in range(1, k))
            best.append((-score, -a, " ".join(phrase).encode(), found[phrase[:cut]], found[phrase[cut:]], n))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right, n) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def rows_of(seed):
    rnd = random.Random(seed)
    words = ["a", "b", "C", "the", "é", "ß", "日本", "x.y", "long" * 40]
    made = [(i, rnd.choice([" ", "  ", "\t"]).join(rnd.choices(words, [9, 8, 7, 6, 4, 2, 2, 1, 1], k=rnd.randrange(0, 60))).replace("é", rnd.choice(["é", "é,", "!é", "é\n"])), rnd.choice(["en", "en", "de", None, ""]), "w", 1, 2) for i in range(60)]
    return [*made, *made[:3], (None, None, "en", None, None, None), (7, "", None, None, None, None), (8, " \t ", "fr", None, None, None), (9, "go go " * 500 + ". stop", "one", None, None, None)]


@pytest.mark.parametrize(("seed", "shard", "least", "top"), [(1, 2_000_000, 3, 2000), (2, 50, 5, 7), (3, 300, 2, 2000)])
def test_collocations(spark, monkeypatch, seed, shard, least, top):
    monkeypatch.setattr(collocations, "SHARD", shard)
    monkeypatch.setattr(collocations, "PART", 100 if shard < 1000 else 2_000_000)
    rows = rows_of(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, collocations.collocations(docs, least, top).collect())) == brute(rows, least, top)


def test_empty(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, None, None, None)], SCHEMA)).count() == 0


@pytest.mark.parametrize("most", [1, 100, 10**6])
def test_bitmaps_grow_over_word_edges(most):
    codes = np.random.default_rng(5).integers(0, 4, 1000)
    found = Counter()
    for words, _, counts in collocations.phrases(collocations.Bitmaps(codes), 5, np.arange(4), most=most):
        for w, n in zip(words.tolist(), counts.tolist(), strict=True):
            assert tuple(w) not in found
            found[tuple(w)] = n
    expected = Counter(tuple(codes[i : i + k].tolist()) for k in range(2, 6) for i in range(1000 - k + 1) if codes[i : i + k].all())
    assert found == expected


def test_portions_cut_at_breaks_only():
    words = [b"a"] * 10 + [b"."] + [b"b"] * 3 + [b"."] + [b"c"] * 30
    cut = list(collocations._portions(words, 5))
    assert sum(cut, []) == words
    assert [len(x) for x in cut] == [10, 35]


def test_no_table_that_grows_is_broadcast(spark):
    """Counts of phrases and words are compressed ten times and more: what looks small enough to broadcast fills the driver."""
    docs = spark.createDataFrame([("en", "a b c d a b c d")] * 60, "lang string, text string")
    found = collocations.collocations(docs)
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert all("[lang#" in line for line in joins) and plan.count("SortMergeJoin") >= 5

"""The pipeline's stages one by one, each against brute force over the rows that it was given."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from test_mixing import reshared

import corpus_pipeline
from termlake.llm import bpe_codec

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
STAGES = [stage for _, stage in corpus_pipeline.STAGES]


def prose(seed, words=60):
    chosen = random.Random(seed)
    return " ".join("".join(chosen.choice("abcdefghijklm") for _ in range(6)) for _ in range(words))


A, B, C, D, E, F, G = map(prose, range(7))
UNIQUE = [(1, A), (2, f"  {A}".strip().replace(" ", "  ")), (3, B), (4, f"{B} end"), (5, C), (6, D), (7, "123 ?"), (8, None), (9, ""), (10, f"{D} end"), (11, E)]
REPEATED = [*UNIQUE, (5, f"{B} more"), (12, F), (12, f"{F} end"), (12, A), (None, A), (None, G), (None, G)]
ONE_NULL = [*UNIQUE, (None, A)]
CASES = {"unique": (UNIQUE, "en"), "repeated": (REPEATED, "en"), "one null": (ONE_NULL, "en"), "no lang": (UNIQUE, None), "und": (UNIQUE, "und"), "empty": ([], "en")}


def squeezed(text):
    return " ".join((text or "").split()) if (text or "").strip() else text or ""


def with_letters(rows):
    return [r for r in rows if any(c.isalpha() for c in r[1] or "")]


def first_of_equal(rows):
    best = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        best.setdefault(squeezed(r[1]), (r[0], squeezed(r[1])))
    return list(best.values())


def first_of_near(rows):
    def jaccard(a, b):
        a, b = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
        return len(a & b) / len(a | b)

    rest, kept = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], hashlib.sha256(r[1].encode()).hexdigest())), [r for r in rows if r[0] is None]
    while rest:
        group, grown = [rest[0]], -1
        while grown != len(group):
            grown = len(group)
            group += [r for r in rest if r not in group and any(jaccard(r[1], g[1]) >= 0.8 for g in group)]
        kept.append(rest[0])
        rest = [r for r in rest if r not in group]
    return kept


def mixed(rows):
    sized, out = defaultdict(list), []
    for r in rows:
        size, chars = len(r[1].split()), len(r[1])
        u = (int(hashlib.md5(f"mix:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        sized[r[3]].append((-math.log(u) / (1.0 if size and 3 <= (chars - size) / size <= 12 else 0.5), r[0] is None, r[0] or 0, size, r))
    goals = reshared({s: sum(x[3] for x in own) for s, own in sized.items()})
    for source, own in sized.items():
        total, ahead = sum(x[3] for x in own), 0
        epochs = min(2, goals[source] // total) if total else 0
        for _, _, _, size, r in sorted(own, key=lambda x: x[:4]):
            out += [r] * int(epochs + (epochs < 2 and size > 0 and ahead + size / 2 < goals[source] - epochs * total))
            ahead += size
    return out


@pytest.mark.parametrize("at", range(4))
def test_clashing_columns(spark, at):
    """Helper columns of a stage take no column of documents with their name."""
    names = ("score", "lang_pred", "copies", "sha", "own_sha", "gone_id", "gone_tie", "digest", "block", "kept", "n", "key", "size", "filter_bit", "mix_id")
    rows = [(i, text, "en", "s", len(text or ""), *(f"{name}{i}" for name in names)) for i, text in REPEATED]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", {name} string" for name in names))
    out = STAGES[at](spark, docs, "")
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.collect()} <= set(rows)
    assert out.count() > 0


@pytest.fixture
def given(spark, request):
    rows, lang = CASES[request.param]
    rows = [(i, text, lang, f"s{at % 3}", len(text or "")) for at, (i, text) in enumerate(rows)]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("given", list(CASES), indirect=True)
def test_stages(spark, given, tmp_path):
    rows, docs = given
    for at, (stage, want) in enumerate(zip(STAGES, (with_letters, first_of_equal, first_of_near, mixed), strict=False)):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{at}")
        docs = spark.read.parquet(f"{tmp_path}/{at}")
        key = {first_of_equal: lambda r: (r[0], squeezed(r[1]))}.get(want, tuple)
        got = [tuple(r) for r in docs.collect()]
        assert Counter(map(key, got)) == Counter(map(key, want(rows))), stage.__name__
        rows = got
    ranks = bpe_codec.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in STAGES[4](spark, docs, "").collect())
    assert found == Counter((r[0], len(whole.encode_ordinary(r[1])), hashlib.sha256(r[1].encode()).hexdigest()) for r in rows)

"""The queries of this folder and their SQL. Each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlake.llm import ann, bpe_codec, collocations, exact_dedup, html_text, language_id, lm_scoring, mixing, near_dedup, prefix_trie, sharding, token_files, toxicity
from termlake.llm.common import fold

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe_codec.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = bpe_codec.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    decoded = bpe_codec.decode(encoded, ranks)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 5) == 0
    scored = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""


def op6_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) == 2)


def op7_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 4) == 2
    found = language_id.identify_documents(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_robust_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search_embeddings(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as vocabulary:
        manifest = token_files.write_tokens(table(spark, sf_dir, "documents"), vocabulary.read(), end_id=1)
    return token_files.read_tokens(manifest, with_ids=False)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, length(text) AS chars,
         ((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
k AS (SELECT doc_id, source, size, -ln(u) / CASE WHEN size > 0 AND (chars - size)::DOUBLE / greatest(size, 1) BETWEEN 3 AND 12 THEN 1.0 ELSE 0.5 END AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
v AS (SELECT *, cap / w AS ratio,
        ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(cap) OVER (ORDER BY cap / w, source COLLATE "C" NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY cap / w, source COLLATE "C" NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT *, max(CASE WHEN ratio > level THEN level END) OVER () AS final FROM v),
t AS (SELECT source, source_size, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * w) END AS target,
        CASE WHEN source_size > 0 THEN least(2, floor(CASE WHEN final IS NULL THEN cap ELSE least(cap, final * w) END / source_size)) ELSE 0 END AS epochs FROM f),
p AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM k)
SELECT p.doc_id, p.size, t.source_size, t.target,
       (size * (epochs + CASE WHEN epochs < 2 AND size > 0 AND ahead + size / 2.0 < target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


#: h has crc32 of the decimal conv_id, eight steps a byte.
OP12_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id FROM t),
h AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda v, ignored: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 4 AS h FROM c),
o AS (SELECT h.conv_id, t.role, t.text, 0 AS own, t.i FROM h JOIN t ON t.conv_id = h.base AND t.i < h.h UNION ALL SELECT h.conv_id, t.role, t.text, 1, t.i FROM h JOIN t ON t.conv_id = h.conv_id AND t.i >= h.h),
r AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS depth FROM o),
k AS (SELECT conv_id, depth, len(regexp_extract_all(text, '[^ 	-
]+')) AS words, sha256(string_agg(sha256(len(role) || ':' || role || ':' || text), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
l AS (SELECT conv_id, max(depth) AS length FROM k GROUP BY conv_id),
n AS (SELECT k.depth, k.key, min(k.conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, sha256(coalesce(string_agg(k.conv_id, ',' ORDER BY k.conv_id) FILTER (k.depth = length), '')) AS ends_sha256 FROM k JOIN l USING (conv_id) GROUP BY ALL),
m AS (SELECT k.conv_id AS member, k.depth, n.conv_id FROM k JOIN n USING (depth, key)),
e AS (SELECT n.*, m.conv_id AS parent_conv_id FROM n LEFT JOIN m ON m.member = n.conv_id AND m.depth = n.depth - 1),
f AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM e WHERE depth > 0 GROUP BY ALL),
g AS (SELECT e.*, coalesce(n_children, 0) AS n_children FROM e LEFT JOIN f USING (conv_id, depth)),
s AS (SELECT m.conv_id, m.depth, count(*) FILTER (g.n_children = 0) AS n_leaves, sum((g.n_convs - 1) * g.words)::BIGINT AS saved_tokens FROM g JOIN m ON m.member = g.conv_id AND m.depth <= g.depth GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM g JOIN s USING (conv_id, depth)
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
o AS (SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS k FROM s),
g AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS f FROM o GROUP BY ALL HAVING count(*) >= 100),
t AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
c AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, k, f AS a FROM g WHERE k >= 2),
b AS (SELECT lang, w, a, k, unnest(range(1, k + 1)) AS i FROM c),
e AS (SELECT lang, w, a, k, i, unnest(range(2, k - i + 2)) AS m FROM b),
v AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM e WHERE m < k GROUP BY ALL),
x AS (SELECT c.*, unnest(range(1, k)) AS cut FROM c LEFT JOIN v USING (lang, phrase) WHERE longer IS NULL OR longer < a),
q AS (SELECT x.lang, x.phrase, x.a, x.cut, f.f AS l, r.f AS r, t.n::BIGINT AS n, ((1000::HUGEINT * x.a * t.n::HUGEINT) // (f.f::HUGEINT * r.f))::BIGINT AS score
      FROM x JOIN g f ON f.lang = x.lang AND f.phrase = array_to_string(x.w[1:x.cut], ' ') JOIN g r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.cut + 1:], ' ') JOIN t ON t.lang = x.lang),
y AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "C") AS rank, phrase, a, l, r, n, score FROM y
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "C") <= 2000
"""


def queries() -> dict[str, Query]:
    made = (op1_near_dedup, op2_byte_bpe, op3_counterfactual_toxicity, op4_virtual_slots, op5_exact_dedup, op6_deleted_interpolation, op7_hyperdimensional_language, op8_robust_graph, op9_token_files, op10_mixing, op11_html_text, op12_prefix_trie, op13_collocations)
    return {query.__name__: query for query in made}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op10_mixing": OP10_SQL, "op12_prefix_trie": OP12_SQL, "op13_collocations": OP13_SQL}

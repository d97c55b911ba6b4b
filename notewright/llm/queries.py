"""Registered queries of the training-data operators, on whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.llm import (
    bpe,
    fingerprints,
    html_extract,
    language_model,
    packing,
    prefix_trie,
    quality,
    secret_scan,
    set_join,
    sharding,
    spelling_forms,
    toxicity,
    voronoi_knn,
)
from notewright.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    @functools.wraps(fn)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, folder)

    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_shards(spark, folder):
    return sharding.shard_documents(table(spark, folder, "documents"))


@query
def op2_fingerprints(spark, folder):
    return fingerprints.fingerprint_documents(table(spark, folder, "documents"))


@query
def op3_bpe(spark, folder):
    return bpe.encode_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op4_language_model(spark, folder):
    return language_model.score_documents(table(spark, folder, "documents"))


@query
def op5_pack(spark, folder):
    return packing.pack(packing.word_lengths(table(spark, folder, "documents")))


@query
def op6_toxicity(spark, folder):
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op7_quality(spark, folder):
    rows = quality.rate(table(spark, folder, "documents"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rows.select(*columns, *quality.UNIT)


@query
def op8_secrets(spark, folder):
    return secret_scan.scan_secrets(table(spark, folder, "documents"))


@query
def op9_jaccard_join(spark, folder):
    return set_join.join_documents(table(spark, folder, "documents")).drop("text_hash")


ORACLES["op9_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [''] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d
),
u AS (SELECT doc_id, unnest(s) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (
    SELECT p.a, p.b FROM p JOIN g ga ON ga.doc_id = p.a JOIN g gb ON gb.doc_id = p.b
    WHERE p.c * 9 >= 4 * (len(ga.s) + len(gb.s))
),
r(v, l) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.l FROM r JOIN e ON e.a = r.v),
n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT r.v AS doc_id, min(r.l) AS class_id, coalesce(any_value(n.n_links), 0) AS n_links FROM r LEFT JOIN n ON n.a = r.v GROUP BY r.v
"""


@query
def op10_html(spark, folder):
    return html_extract.extract_pages(table(spark, folder, "pages"))


def crc32_sql(codes: str) -> str:
    """SQL for the unsigned CRC-32 of a list of byte values."""
    step = "list_reduce(range(8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(c, b))"
    return f"xor(list_reduce({codes}, lambda c, b: {step}, 4294967295::BIGINT), 4294967295)"


@query
def op11_voronoi_knn(spark, folder):
    return voronoi_knn.knn_join(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op11_voronoi_knn"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op12_prefix_trie(spark, folder):
    turns, convs = prefix_trie.shared_beginnings(prefix_trie.placed_turns(table(spark, folder, "conversations")))
    return prefix_trie.prefix_trie(turns, convs)


ORACLES["op12_prefix_trie"] = r"""
WITH c AS (
    SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST,
        sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS own
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
h AS (SELECT *, CRC % 4 AS h FROM (SELECT *, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substring(conv_id::VARCHAR, i, 1))) AS codes FROM c)),
p AS (SELECT h.conv_id, coalesce(b.own, [])[1:h.h] || h.own[h.h + 1:] AS s FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 20),
m AS (SELECT conv_id, s, unnest(range(len(s) + 1)) AS depth FROM p),
n AS (
    SELECT depth, s[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
        list(conv_id ORDER BY conv_id) FILTER (len(s) = depth) AS ends FROM m GROUP BY ALL
),
k AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n FROM n WHERE depth > 0 GROUP BY ALL),
w AS (
    SELECT n.*, coalesce(k.n, 0) AS n_children, CASE WHEN n.depth = 0 THEN 0
        ELSE (n.n_convs - 1) * len(regexp_extract_all(n.path[-1].t, '[^ 	-
]+')) END AS saved
    FROM n LEFT JOIN k ON k.depth = n.depth AND k.path = n.path
),
up AS (SELECT unnest(range(depth + 1)) AS depth, path, saved, n_children FROM w),
below AS (SELECT depth, path[1:depth] AS path, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM up GROUP BY ALL)
SELECT w.conv_id, w.depth, q.conv_id AS parent_conv_id, w.n_convs, w.n_children, below.n_leaves, below.saved_tokens,
    sha256(coalesce(array_to_string(w.ends, ','), '')) AS ends_sha256
FROM w JOIN below ON below.depth = w.depth AND below.path = w.path
LEFT JOIN n q ON q.depth = w.depth - 1 AND q.path = w.path[1:w.depth - 1]
""".replace("CRC", crc32_sql("codes"))


@query
def op13_spelling_forms(spark, folder):
    return spelling_forms.spelling_forms(table(spark, folder, "documents"))


ORACLES["op13_spelling_forms"] = """
WITH RECURSIVE d AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents
),
r AS (SELECT doc, run, count(*) AS n FROM (SELECT doc, unnest(regexp_extract_all(t, '[A-Za-zÀ-ÿ]+')) AS run FROM d) GROUP BY ALL),
x AS (SELECT *, hex(encode(doc || ':' || run)) AS hex FROM r),
b AS (SELECT run, n, list_transform(range(1, len(hex), 2), lambda i: ('0x' || hex[i:i + 1])::BIGINT) AS codes FROM x),
h AS (SELECT run, n, CRC AS h FROM b),
e AS (SELECT CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM e WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
o AS (
    SELECT word, length(word) AS size, unnest(range(length(word) + 1)) AS i FROM v
),
g AS (SELECT word, size, i, word[1:i - 1] || word[i + 1:] AS hole FROM o WHERE i > 0),
pairs AS (
    SELECT a.word, b.word AS near FROM g a JOIN g b ON a.hole = b.hole AND a.i = b.i AND a.size = b.size AND a.word <> b.word
    UNION SELECT g.word, v.word FROM g JOIN v ON g.hole = v.word
    UNION SELECT v.word, g.word FROM g JOIN v ON g.hole = v.word
),
best AS (
    SELECT p.word, count(*) AS n_near, arg_min(p.near, (-v.n, p.near)) AS near, max(v.n) AS near_n FROM pairs p JOIN v ON v.word = p.near GROUP BY p.word
),
f AS MATERIALIZED (
    SELECT v.word, v.n, coalesce(best.n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form,
        CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n FROM v LEFT JOIN best ON best.word = v.word
),
walk(word, r) AS (SELECT word, word FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.r WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.r AS root, f.n, f.n_near, f.form_n
FROM f JOIN walk ON walk.word = f.word JOIN f z ON z.word = walk.r AND z.form IS NULL
""".replace("CRC", crc32_sql("codes"))

"""Word vocabulary and token-id rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.operators import encode as enc
from notewright.operators import vocabulary as vo
from notewright.operators import windows as wn
from notewright.plans.registry import query

WORDS = """
    w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS words FROM documents)"""


VOCABULARY = """
    c AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM w) GROUP BY word),
    v AS (SELECT word, CAST(row_number() OVER (ORDER BY n DESC, word) + 2 AS INT) AS id FROM c
          WHERE word NOT IN ('[UNK]', '[PAD]', '[MASK]')),
    voc AS (SELECT * FROM v UNION ALL SELECT * FROM (VALUES ('[UNK]', 0), ('[PAD]', 1), ('[MASK]', 2)) AS s(word, id))"""


IDS = f"""
    WITH {WORDS}, {VOCABULARY},
    e AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM w),
    i AS (SELECT e.doc_id, list(coalesce(voc.id, 0) ORDER BY pos) AS ids FROM e LEFT JOIN voc USING (word) GROUP BY e.doc_id),
    x AS (SELECT w.doc_id, coalesce(i.ids, []) AS ids FROM w LEFT JOIN i USING (doc_id))"""


def _joined(column):
    return F.array_join(F.col(column).cast("array<string>"), " ")


def _vocabulary(corpus):
    return vo.build(corpus.documents)


def _ids(corpus):
    return vo.encode(corpus.documents, "doc_id", _vocabulary(corpus))


@query("V01", f"WITH {WORDS} SELECT doc_id, CAST(len(words) AS INT) AS n_words, array_to_string(words, ' ') AS words FROM w")
def v01(corpus):
    return corpus.documents.withColumn("words", vo.words(F.col("text"))).select(
        "doc_id", F.size("words").alias("n_words"), F.array_join("words", " ").alias("words")
    )


@query("V02", f"WITH {WORDS}, {VOCABULARY} SELECT word, id FROM voc")
def v02(corpus):
    return _vocabulary(corpus)


@query(
    "V03",
    """
    SELECT word, n, sum(1) OVER () AS vocabulary_size FROM (
        SELECT word, count(*) AS n FROM v_words WHERE word <> '' GROUP BY word) ORDER BY word""".replace(
        "sum(1) OVER ()", "CAST(count(*) OVER () + 3 AS BIGINT)"
    ),
)
def v03(corpus):
    """Listing by word, with the vocabulary size (special tokens included)."""
    counts = vo.word_counts(enc.encode(corpus.notes, corpus.tracks))
    size = counts.agg(F.count("*") + 3).scalar()
    return counts.select("word", "n", size.alias("vocabulary_size")).orderBy("word")


@query("V04", f"{IDS} SELECT doc_id, array_to_string(ids, ' ') AS input_ids FROM x")
def v04(corpus):
    return _ids(corpus).select("doc_id", _joined("input_ids").alias("input_ids"))


@query("V05", f"{IDS} SELECT doc_id, CAST(len(ids[1:2048]) AS INT) AS size, array_to_string(ids[1:2048], ' ') AS input_ids FROM x")
def v05(corpus):
    cut = vo.truncate(_ids(corpus))
    return cut.select("doc_id", F.size("input_ids").alias("size"), _joined("input_ids").alias("input_ids"))


_PADDED = f"""
    {IDS}, t AS (SELECT doc_id, doc_id // 100 AS batch_id, ids[1:2048] AS ids FROM x),
    m AS (SELECT batch_id, max(len(ids)) AS longest FROM t GROUP BY batch_id),
    p AS (SELECT doc_id, ids || list_transform(range(longest - len(ids)), lambda i: 1) AS ids, len(ids) AS kept
          FROM t JOIN m USING (batch_id))"""


def _padded(corpus):
    cut = vo.truncate(_ids(corpus)).withColumn("batch_id", F.floor(F.col("doc_id") / 100))
    return vo.pad(cut, "batch_id")


@query("V06", f"{_PADDED} SELECT doc_id, array_to_string(ids, ' ') AS input_ids, CAST(kept AS INT) AS mask_sum, CAST(len(ids) AS INT) AS mask_size FROM p")
def v06(corpus):
    total = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    return _padded(corpus).select(
        "doc_id", _joined("input_ids").alias("input_ids"), total.alias("mask_sum"), F.size("attention_mask").alias("mask_size")
    )


@query(
    "V07",
    f"""
    {IDS} SELECT w.doc_id, array_to_string(list_transform(words, lambda o: o), ' ') AS text FROM w WHERE false
    UNION ALL SELECT e.doc_id, string_agg(CASE WHEN voc.word IS NULL THEN '[UNK]' ELSE e.word END, ' ' ORDER BY pos)
    FROM e LEFT JOIN voc USING (word) GROUP BY e.doc_id""",
)
def v07(corpus):
    vocabulary = _vocabulary(corpus)
    ids = vo.encode(corpus.documents, "doc_id", vocabulary)
    return vo.to_text(ids, "doc_id", vocabulary)


@query(
    "V08",
    f"{_PADDED} SELECT doc_id, array_to_string(list_transform(ids, lambda i: CASE WHEN i = 1 THEN -100 ELSE i END), ' ') AS labels FROM p",
)
def v08(corpus):
    return vo.labels(_padded(corpus)).select("doc_id", _joined("labels").alias("labels"))


@query(
    "V09",
    f"""
    {IDS}, r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents)
    SELECT r.doc_id, CAST(rn AS INT) AS row, array_to_string(ids, ' ') AS input_ids
    FROM r JOIN x USING (doc_id) WHERE rn < 100 AND rn % 20 = 0""",
)
def v09(corpus):
    """Strided sample of texts beside their own ids."""
    sample = wn.strided_head(corpus.documents, "doc_id", 100, 20)
    ids = vo.checked(vo.encode(sample, "doc_id", _vocabulary(corpus)))
    return sample.select("doc_id", "row").join(ids, "doc_id").select("doc_id", "row", _joined("input_ids").alias("input_ids"))


@query("V10", f"{IDS} SELECT doc_id, array_to_string(ids, ' ') AS input_ids FROM x ORDER BY doc_id LIMIT 100")
def v10(corpus):
    """Only the first 100 texts are encoded; the limit is the operator's parameter."""
    head = corpus.documents.orderBy("doc_id").limit(100)
    return vo.encode(head, "doc_id", _vocabulary(corpus)).select("doc_id", _joined("input_ids").alias("input_ids"))

"""Operator 1: benchmark decontamination, with DataFrame expressions only.

An item (a short test text) leaks into a document when at least 80 % of its
distinct five-word shingles occur there. Containment of ``t`` lets an item of
``q`` shingles miss at most ``q - ceil(t q)`` of them, so of any
``q - ceil(t q) + 1`` chosen ones the document has one. Those with the smallest
hashes, the item's MinHash sketch, are what the search looks up; items are
partitioned by size, and all of a partition have the sketch length that its
largest needs. Each document's shingles are looked up in the sketches; the
items that are hit are then verified against all shingles of the document.

Words are lower-cased and cut at ASCII white space. A text of fewer than five
words is one shingle; without words, or null, it has none and matches nothing.
Texts of any length are taken whole. Repeated rows of a document or an item count
as one; ids may be null. An empty table on either side gives no leaks; columns
beyond ids and texts may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.llm.common import NGRAM, SIMILAR_PERCENT, SPACE, materialize, unused

#: Sketches and items are broadcast up to so many hashes (16 bytes each); more are joined by shuffling.
BROADCAST_HASHES = 2_000_000


def shingles(text: str, out: str, docs: DataFrame) -> DataFrame:
    """``docs`` with ``out``: the hash of each shingle of a text, in order."""
    words = F.split(F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(" \t\n\x0b\x0c\r")), SPACE)

    def of(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - NGRAM), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(NGRAM)]))
        few = F.when(F.get(w, F.lit(0)) != "", F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(w) >= NGRAM, each).otherwise(few)

    # bound by a lambda, the words are made once wherever the optimizer puts this
    return docs.withColumn(out, F.get(F.transform(F.array(words), of), F.lit(0)))


def _needed(size: Column, percent: int) -> Column:
    return (size - F.ceil(size * percent / 100) + 1).cast("int")


def sketches(items: DataFrame, percent: int) -> DataFrame:
    """(item, n_item, item_shingles, sketch) of each distinct item, by size class."""
    df = shingles("text", "hashes", items.select(F.col("item_id").alias("item"), "text"))
    df = df.select("item", F.array_sort(F.array_distinct("hashes")).alias("item_shingles")).where(F.size("item_shingles") > 0).distinct()
    df = df.withColumns({"n_item": F.size("item_shingles"), "class": F.floor(F.log2(F.size("item_shingles"))).cast("int")})
    largest = F.pow(F.lit(2.0), F.col("class") + 1) - 1
    length = F.least(F.col("n_item"), _needed(largest, percent))
    return df.withColumn("sketch", F.slice("item_shingles", F.lit(1), length))


def search(docs: DataFrame, items: DataFrame, percent: int = SIMILAR_PERCENT) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every leak."""
    known = materialize(sketches(items, percent), "items")
    total = known.agg(F.coalesce(F.sum("n_item"), F.lit(0))).first()[0]
    probes = known.select("item", "n_item", "item_shingles", F.explode("sketch").alias("hash"))
    texts = shingles("text", "doc_shingles", docs.select("doc_id", "text"))
    if total <= BROADCAST_HASHES:
        ids = F.broadcast(probes.select("hash", "item"))
        # the document's array is only copied for the rows that the lookup lets through
        hits = texts.select("doc_id", "doc_shingles", F.explode_outer("doc_shingles").alias("hash")).join(ids, "hash").drop("hash")
        hits = hits.join(F.broadcast(known.select(F.col("item").alias("__item"), "n_item", "item_shingles")), F.col("item").eqNullSafe(F.col("__item"))).drop("__item")
    else:
        ids = texts.select("doc_id", F.explode(F.array_distinct("doc_shingles")).alias("hash")).join(probes.select("hash", "item"), "hash").select("doc_id", "item").distinct()
        hits = texts.join(ids.withColumnRenamed("doc_id", "__id"), F.col("doc_id").eqNullSafe(F.col("__id"))).drop("__id")
        hits = hits.join(known.select(F.col("item").alias("__item"), "n_item", "item_shingles"), F.col("item").eqNullSafe(F.col("__item"))).drop("__item")
    shared = hits.select("doc_id", F.col("item").alias("item_id"), "n_item", F.size(F.array_intersect("item_shingles", "doc_shingles")).alias("n_shared"))
    found = shared.where(F.col("n_shared") * 100 >= F.col("n_item") * percent).groupBy("doc_id", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared"))
    return found.select("doc_id", "item_id", F.col("n_item").cast("long"), F.col("n_shared").cast("long"), (F.col("n_shared") / F.col("n_item")).alias("containment"))


def remove(docs: DataFrame, items: DataFrame, percent: int = SIMILAR_PERCENT) -> DataFrame:
    """``docs`` without the documents into which an item leaks."""
    leak = unused("leak", docs.columns)
    leaks = search(docs, items, percent).select(F.col("doc_id").alias(leak)).distinct()
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col(leak)), "left_anti")


ORACLE = rf"""
WITH words AS (SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') FROM benchmark),
sets AS (SELECT kind, id, list_distinct(CASE WHEN len(w) >= {NGRAM} THEN list_transform(range(1, len(w) - {NGRAM - 2}), lambda i: array_to_string(w[i:i + {NGRAM - 1}], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
items AS (SELECT id, len(s) AS n, unnest(s) AS x FROM sets WHERE kind = 'i'),
docs AS (SELECT id, unnest(s) AS x FROM sets WHERE kind = 'd')
SELECT d.id AS doc_id, i.id AS item_id, any_value(n)::BIGINT AS n_item, count(*)::BIGINT AS n_shared, count(*) / any_value(n) AS containment
FROM docs d JOIN items i USING (x) GROUP BY d.id, i.id HAVING count(*) * 100 >= any_value(n) * {SIMILAR_PERCENT}
"""

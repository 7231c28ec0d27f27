"""Operator 10: language identification by multinomial naive Bayes.

Hashed character n-grams (1 to 3 lower-cased code points) are counted per
language on a bounded sample of labelled rows; the matrix of log-probabilities
(languages x buckets) is broadcast; documents are scored in numpy batches.

Null texts and texts without a letter (``str.isalpha``) give ``und`` with score
0, as do all texts when nothing could be learned. Equal scores go to the first
language in order of name. Texts of any length are scored whole, in pieces of
``BATCH_CHARS``. Rows are independent, so repeated rows give repeated results;
an empty table gives none. Columns beyond doc_id, text and lang may have any
name. More than ``MOST_LANGUAGES`` languages are refused with an error, as the
broadcast matrix has a row of 128 KB for each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.llm.common import plain_names

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
SMOOTHING = 0.5
#: Bound of the training sample: so many documents of a language, chosen by hash.
TRAIN_PER_LANGUAGE = 3000
HELD_OUT_OF, HELD_OUT = 3, 1
BATCH_CHARS = 1 << 19
MOST_LANGUAGES = 1000
_WORD_CHARACTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % HELD_OUT_OF == HELD_OUT


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _WORD_CHARACTER.finditer(text))  # the pattern also takes signs such as one half


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_prob: np.ndarray  # BUCKETS x languages
    log_prior: np.ndarray


def buckets(text: str) -> Iterator[np.ndarray]:
    """Bucket of each n-gram of each order of a whole text, in pieces of about ``BATCH_CHARS``."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for n in ORDERS:
        for at in range(0, len(c) - n + 1, BATCH_CHARS):
            own = c[at : at + BATCH_CHARS + n - 1].astype(np.uint64)
            h = np.full(len(own) - n + 1, n, np.uint64)
            for j in range(n):
                h = (h ^ own[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            yield (h >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)


def fit(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE, seed: int = 7) -> Model:
    """Learn from rows that are not held out and have text and lang; the sample is bounded by ``per_language``."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(~held_out(F.col("doc_id")), F.lit(False)))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    languages = tuple(sorted(sizes))
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; the matrix holds {MOST_LANGUAGES} at most")
    if not languages:
        return Model((), np.zeros((BUCKETS, 0)), np.zeros(0))
    rate = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / sizes[k]))])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < rate[F.col("lang")] * (1 << 20)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for piece in buckets(text):
                    sums[lang] += np.bincount(piece, minlength=BUCKETS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": total[at]})

    counted = rows.where(drawn).select("lang", "text").mapInPandas(count, "lang string, bucket long, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most languages x BUCKETS rows
    total = np.full((BUCKETS, len(languages)), SMOOTHING)
    where = table["lang"].map({k: i for i, k in enumerate(languages)})
    np.add.at(total, (table["bucket"].to_numpy(np.int64), where.to_numpy(np.int64)), table["n"].to_numpy(float))
    prior = np.array([min(sizes[k], per_language) for k in languages], float)
    return Model(languages, np.log(total / total.sum(0)).astype(np.float32), np.log(prior / prior.sum()))


def predict(docs: DataFrame, model: Model, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with all its columns, and the predicted language and its posterior in two more that it must not have yet."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = docs.select("*", F.lit("").alias(pred), F.lit(0.0).alias(score)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch["text"].to_pylist()
            sums, known = np.zeros((len(texts), len(m.languages))), np.zeros(len(texts), bool)
            rows, parts, size = [], [], 0

            def flush() -> None:
                nonlocal rows, parts, size
                if rows:
                    starts = np.cumsum([0, *map(len, parts[:-1])])
                    np.add.at(sums, rows, np.add.reduceat(m.log_prob[np.concatenate(parts)], starts, axis=0, dtype=np.float64))
                rows, parts, size = [], [], 0

            for i, text in enumerate(texts):
                if m.languages and text is not None and has_letter(text):
                    known[i] = True
                    for piece in buckets(text):
                        rows.append(i)
                        parts.append(piece)
                        size += len(piece)
                        if size >= BATCH_CHARS:
                            flush()
            flush()
            lang, share = ["und"] * len(texts), np.zeros(len(texts))
            if known.any():
                found = sums[known] + m.log_prior
                share[known] = 1 / np.exp(found - found.max(1, keepdims=True)).sum(1)
                for i, best in zip(np.flatnonzero(known), found.argmax(1)):
                    lang[i] = m.languages[best]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(share)], names=[*batch.schema.names, pred, score])

    return docs.mapInArrow(run, kinds)


def identify(docs: DataFrame) -> DataFrame:
    """Fit on ``docs`` and predict every whole text of ``docs``."""
    out = predict(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


#: A document stays if its language is known with so much certainty.
KEEP_SCORE = 0.5


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents whose language can't be told (``und`` or a low score); a null lang is filled in."""
    plain = plain_names(docs)
    out = predict(plain, fit(plain)).where((F.col("lang_pred") != "und") & (F.col("score") >= KEEP_SCORE))
    return out.withColumn("lang", F.coalesce("lang", "lang_pred")).drop("lang_pred", "score").toDF(*docs.columns)

"""Language identification by multilingual mixture inference.

A document is a bag of letter trigrams drawn from a mixture of language models.  Expectation-
maximisation estimates the proportions; the language set grows from the best single language while the
log-likelihood gained is more than a penalty for the added language.

Training: trigram counts a language, from at most about ``MAX_TRAIN`` documents each, taken by a hash of
their id from the documents whose crc32(doc_id as text) mod 4 is not 2.  Models are hashed tables of 2 ** 16
cells a language, bounded whatever the corpus.  Prediction reads the whole text and nothing but it.

Defined cases: null text, or text without a letter, is ``und`` with score 0; without any labelled
document everything is ``und``; rows repeat independently; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import chunks, column, read

CELLS = 1 << 16
MAX_TRAIN = 2000
STEPS = 10
#: Log-likelihood that a further language has to add: this many times the log of the trigrams.
PENALTY = 8.0


@cache
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts end to end, and the text that each is of.  Lower case; a run of
    anything but letters is one blank; texts begin and end with a blank."""
    table = letters()
    codes = np.frombuffer("\n".join(["", *((x or "").replace("\n", " ").lower() for x in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.cumsum(codes == 10) - 1
    keep = table[codes]
    keep[1:] |= keep[:-1] | (codes[1:] == 10)
    keep[0] = True
    letter = table[codes]
    c = np.where(letter, codes, 32)[keep].astype(np.uint32)
    t = text[keep]
    h = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F)
    # a trigram counts if its middle is a letter and it stays inside one text; blanks join at the edges
    ok = c[1:-1] != 32
    return (h >> np.uint32(16)).astype(np.int64)[ok], t[1:-1][ok]


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)), F.lit(0)) != 2)


def train(docs: DataFrame, max_docs: int = MAX_TRAIN) -> tuple[list[str], np.ndarray]:
    """Languages and their probabilities of each cell (cells x languages)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    names = sorted(sizes)
    if not names:
        return [], np.empty((CELLS, 0), np.float32)
    # uniform in [0, 1) from the id: below the language's share, a document is in the sample
    place = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = F.create_map(*[x for k in names for x in (F.lit(k), F.lit(min(1.0, max_docs / sizes[k])))])
    number = F.create_map(*[x for i, k in enumerate(names) for x in (F.lit(k), F.lit(i))])
    sample = rows.where(place < share[F.col("lang")]).select(number[F.col("lang")].alias("k"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), CELLS), np.int64)
        for part in chunks(batches, "text"):
            grams, of = trigrams(part.column(1).to_pylist())
            k = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            total += np.bincount(k[of] * CELLS + grams, minlength=total.size).reshape(total.shape)
        lang, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int64()), pa.array(cell, pa.int64()), pa.array(total[lang, cell], pa.int64())], ["k", "cell", "n"])

    found = sample.mapInArrow(count, "k long, cell long, n long").groupBy("k", "cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((CELLS, len(names)), 0.05)
    table[found["cell"].to_numpy(), found["k"].to_numpy()] += found["n"].to_numpy()
    return names, (table / table.sum(0)).astype(np.float32)


def infer(texts: list[str | None], table: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts x languages; rows of 0 where a text has no letter) and trigram counts."""
    n, k = len(texts), table.shape[1]
    grams, of = trigrams(texts)
    cells, many = np.unique(of * CELLS + grams, return_counts=True)
    of, cell, c = cells // CELLS, cells % CELLS, many.astype(np.float32)
    total = np.bincount(of, c, n)
    out = np.zeros((n, k))
    if not len(of):
        return out, total
    p = table[cell]
    logp = np.log(p)
    at = np.flatnonzero(np.diff(of, prepend=-1))
    doc = of[at]
    single = np.add.reduceat(c[:, None] * logp, at)
    best = np.zeros(n, np.int64)
    best[doc] = single.argmax(1)
    like = np.zeros(n)
    like[doc] = single.max(1)
    out[doc, best[doc]] = 1.0
    active = np.zeros(n, bool)
    active[doc] = k > 1
    for _ in range(k - 1):
        rows = active[of]
        if not rows.any():
            break
        o, cc, pp = of[rows], c[rows], p[rows]
        at = np.flatnonzero(np.diff(o, prepend=-1))
        d = o[at]
        local = np.repeat(np.arange(len(d)), np.diff(np.append(at, len(o))))
        # the language whose first grain of probability gains most
        inside = np.einsum("ij,ij->i", pp, out[o].astype(np.float32))
        gain = np.add.reduceat((cc / inside)[:, None] * pp, at) / total[d][:, None]
        gain[out[d] > 0] = 0
        add = gain.argmax(1)
        rises = gain[np.arange(len(d)), add] > 1
        pi = out[d] * 0.8
        pi[np.arange(len(d)), add] = np.where(rises, 0.2, 0)
        pi /= pi.sum(1, keepdims=True)
        live = np.flatnonzero(out.sum(0) + np.bincount(add, minlength=k))
        q = pi[:, live].astype(np.float32)
        pl = np.ascontiguousarray(pp[:, live])
        for _ in range(steps):
            r = pl * q[local]
            r *= (cc / r.sum(1))[:, None]
            q = (np.add.reduceat(r, at) / total[d][:, None]).astype(np.float32)
        now = np.add.reduceat(cc * np.log((pl * q[local]).sum(1)), at)
        better = rises & (now - like[d] > penalty * np.log(total[d] + 1))
        keep = d[better]
        out[keep] = 0
        out[np.ix_(keep, live)] = q[better]
        like[keep] = now[better]
        active[:] = False
        active[keep] = True
    return out, total


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; its other columns ride along under their own names.  ``text`` may be a field
    of a struct (``a.b``), so that texts travel once."""
    names, table = model
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(table)  # 256 KB a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text, 1 << 20):
            texts = column(part, text).to_pylist()
            if names:
                share, total = infer(texts, shared.value)
            else:
                share, total = np.zeros((len(texts), 1)), np.zeros(len(texts))
            top = share.argmax(1)
            lang = [names[t] if n else "und" for t, n in zip(top.tolist(), total.tolist(), strict=True)]
            score = np.clip(share[np.arange(len(top)), top], 0, 1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*part.schema.names, "lang_pred", "score"])

    schema = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    return docs.mapInArrow(run, schema)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(learnable(docs))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op3_langid": op3_langid}
#: A trained model: tested by held-out accuracy and planted mixtures.
ORACLE: dict[str, str] = {}

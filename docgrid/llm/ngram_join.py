"""Word n-gram Jaccard join by parity sketches.

A document's set is its distinct 5-word shingles.  Shingles fall into the pieces of a sketch by hash and are
added there by exclusive or, each with its whole 64-bit hash, so two sketches differ in at most as many pieces
as the sets differ in shingles, and pieces of different shingles are equal only if 64-bit hashes collide.
Jaccard >= 0.8 bounds the symmetric difference by D = (|A| + |B|) / 9, so of P pieces at least
P - D are equal: with a common order of pieces, the first D + 1 of either side share one (pigeonhole).
Documents of sizes within a factor of two share a geometry; a document near the upper end of a band
also joins the band below, so that every pair that could link meets in one.

Of the order, pieces of many shingles come first: they are rarely those of a passage alone.  D + c of them and s
more, a number of the band, become keys, the documents of each key are counted, and each document drops its s most
common keys (what two documents both drop are the most common of the keys that they share, so c remain shared).
A key that nobody shares finds nothing, and a document with fewer than c keys left has no partner, so most documents
drop out at once, and passages that many documents share are keys only where a document has little else.

Steps: sketch every document and collapse equal sets; emit the pieces as keys and count them; keep each
document's first keys; pair by key; test candidates by size, by Hamming distance of whole-document sketches,
then exactly on the sets; contract.  Keys of a few documents give their pairs, of which those remain that
share as many keys as the order's first D + c pieces must.  In larger keys each document is tested
against its most frequent partner only, so a group of near copies costs a star and not all its pairs; keys
whose documents are in one component need nothing more.  The pairs left - in one key, of fitting sizes,
in different components - are all tested.

Defined cases: null, empty or blank text: empty set, linked with nothing; fewer than five words: the
whole sequence is the one shingle; rows that share a doc_id are apart while links are sought, each text by itself,
and, where they have words, share a component when it is reported; null ids are one id that orders last and comes back
as null; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SLOTS, binary, chunks, gram_hashes, id_back, id_col, materialize, mix, read, signed, slot_filter, word_hashes
from .graph import components

WORDS = 5
#: Link when PERCENT * union <= 100 * intersection.
PERCENT = 80
#: Rows of a key that are held to count them; keys of more documents count as this many.
LONG = 4096
#: Documents of a key that are paired outright; larger keys go through their first document.
FEW = 8
#: Documents of a key that a task compares with each other, or with as many more.
BLOCK = 4096


def shingle_sets(texts: list[bytes | None], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, end to end; and the sizes of the sets."""
    flat, sizes = word_hashes([x and x.lower() for x in texts])  # of bytes: A-Z only
    grams = gram_hashes(flat, n)
    starts = np.cumsum(sizes) - sizes
    many = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    out = np.empty(int(many.sum()), np.uint64)
    at = 0
    for start, size, k in zip(starts.tolist(), sizes.tolist(), many.tolist(), strict=True):
        if size >= n:
            out[at : at + k] = grams[start : start + k]
            out[at : at + k].sort()
        elif k:
            out[at] = gram_hashes(flat[start : start + size], size)[0] ^ np.uint64(size)
        at += k
    first = np.cumsum(many) - many
    new = np.empty(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[first[many > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return out[new], kept[first + many] - kept[first]


def per_set(own: np.ndarray, sizes: np.ndarray, f: np.ufunc) -> np.ndarray:
    """f reduced over each set; 0 for an empty one."""
    out = np.zeros(len(sizes), np.uint64)
    if len(own):
        out[sizes > 0] = f.reduceat(own, (np.cumsum(sizes) - sizes)[sizes > 0])
    return out


def sketch_bits(n: int) -> int:
    """Two to four bits a shingle; powers of two, so that a sketch folds to half its size by exclusive or."""
    return 1 << min(max((n - 1).bit_length() + 1, 6), 17)


def distance(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded to the size of the other."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        half = len(x) // 2
        x = (int.from_bytes(x[:half]) ^ int.from_bytes(x[half:])).to_bytes(half)
    return (int.from_bytes(x) ^ int.from_bytes(y)).bit_count()


def nodes(docs: DataFrame) -> DataFrame:
    """``docs`` (id, text and others) with ``doc``, what is linked: the id, or where an id of the same hash slot has
    several texts, a number of id and text.  Rows alike in both are one document."""
    own = F.xxhash64("id", "text").bitwiseAND((1 << 63) - 1)  # the sign is taken off in best_partner
    slot = F.pmod(F.xxhash64("id"), F.lit(SLOTS)).alias("_slot")
    texts = docs.groupBy("id").agg(F.min(own).alias("_low"), F.max(own).alias("_high")).where("_low <> _high")
    several = materialize(texts.select(slot).distinct(), "ngram-several").withColumn("_more", F.lit(True))
    rows = docs.withColumn("_slot", slot).join(F.broadcast(several), "_slot", "left")
    return rows.select(F.when(F.col("_more"), own).otherwise(F.col("id")).alias("doc"), *docs.columns)


def profile(docs: DataFrame) -> DataFrame:
    """doc, n, two set hashes and a whole-set parity sketch of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            own, sizes = shingle_sets(binary(part, "text"))
            row = np.repeat(np.arange(len(sizes)), sizes)
            bits = np.array([sketch_bits(n) for n in sizes.tolist()], np.int64)
            ends = np.cumsum(bits)
            spot = (ends - bits)[row] + (own >> np.uint64(40)).astype(np.int64) % bits[row]
            flat = np.packbits((np.bincount(spot, minlength=int(bits.sum())) & 1).astype(np.uint8)).tobytes()
            sketch = [flat[(e - b) // 8 : e // 8] for b, e in zip(bits.tolist(), ends.tolist(), strict=True)]
            h1, h2 = per_set(own, sizes, np.bitwise_xor), per_set(mix(own + np.uint64(1)), sizes, np.add)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(signed(h1)), pa.array(signed(h2)), pa.array(sketch, pa.binary())], ["doc", "n", "h1", "h2", "sketch"])

    return materialize(docs.mapInArrow(run, "doc long, n long, h1 long, h2 long, sketch binary"), "ngram-profile")


def overlap(band: int) -> int:
    """Keys of small groups that a pair has to share in a band: when both sides emit the first D + c of their
    pieces, they share c."""
    return (1, 1, 1, 1, 2, 2, 3, 4, 6, 8)[min(band, 9)]


def spare(band: int) -> int:
    """Keys above those that count: as many of the most common ones are dropped."""
    return 0 if band < 5 else max(2, (2 << band) // 64)


def geometry(n: int) -> list[tuple[int, int, int]]:
    """Bands of a set of n: (band, pieces, keys that count: pieces that may differ + overlap).  A set has only bands
    in which it may be the smaller one of a pair, or the larger one of a pair whose smaller one is of the band."""
    out = []
    for band in range(max(0, n.bit_length() - 2), n.bit_length()):
        top = (2 << band) - 1  # the largest size of a pair's smaller set in this band
        if n <= top + top // 4:
            # pieces of about three shingles; single shingles where sets are small, so that none is empty
            pieces = 1024 if top < 32 else (top + 1) // 3 + 16
            differ = n // 4 if n <= top else (top + n) // 9
            if differ:  # else only equal sets link
                out.append((band, pieces, differ + overlap(band)))
    return out


def lowest_band(n: int) -> int:
    found = geometry(n)
    return found[0][0] if found else 0


def sketch_keys(own: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of each set - for each of its bands a hash of its first pieces: those of the most shingles, ``spare``
    more than count - with the set that each key is of, and its band."""
    first = np.cumsum(sizes) - sizes
    sets = [(i, *g) for i, n in enumerate(sizes.tolist()) if n for g in geometry(n)]
    if not sets:
        return np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 2
    row, band, pieces, need = (np.array(x, np.int64) for x in zip(*sets, strict=True))
    need += np.array([spare(k) for k in range(64)])[band]
    many = sizes[row]
    end = np.cumsum(many)
    of = np.repeat(np.arange(len(row)), many)  # set and band of each element
    h = own[np.arange(end[-1]) - np.repeat(end - many, many) + np.repeat(first[row], many)]
    base = np.cumsum(pieces) - pieces
    spot = base[of] + ((h >> np.uint64(24)) % pieces[of].astype(np.uint64)).astype(np.int64)
    order = np.argsort(spot)
    spot, h = spot[order], h[order]
    starts = np.flatnonzero(np.diff(spot, prepend=-1))
    parity = np.bitwise_xor.reduceat(mix(h), starts)
    spot = spot[starts]
    of = np.searchsorted(base, spot, side="right") - 1
    key = mix(parity * np.uint64(0x9E3779B97F4A7C15) + (spot - base[of]).astype(np.uint64) * np.uint64(64) + band[of].astype(np.uint64))
    # a function of the piece's shingles alone: as many as can be, then by hash
    held = np.minimum(np.diff(np.append(starts, len(h))), 255).astype(np.uint64)
    order = np.lexsort([(np.uint64(255) - held) << np.uint64(56) | (key >> np.uint64(8)), of])
    have = np.bincount(of, minlength=len(row))
    rank = np.arange(len(of)) - np.repeat(np.cumsum(have) - have, have)
    chosen = order[rank < need[of]]
    key, at, spot = key[chosen], of[chosen], spot[chosen]
    for k in np.flatnonzero(have < need):  # equal empty pieces count too
        empty = np.setdiff1d(np.arange(pieces[k]), spot[at[: len(spot)] == k] - base[k])[: need[k] - have[k]]
        key = np.concatenate([key, mix(empty.astype(np.uint64) * np.uint64(64) + np.uint64(band[k]))])
        at = np.concatenate([at, np.full(len(empty), k)])
    return key, row[at], band[at]


def representatives(docs: DataFrame, base: DataFrame) -> DataFrame:
    """``docs`` without those whose set is another one's too.  Only documents in the hash slots of such
    copies have to meet the list of them."""
    copies = base.where("n > 0 and doc <> rep").select("doc").distinct()
    slot = F.pmod(F.xxhash64("doc"), F.lit(SLOTS)).alias("_slot")
    taken, rows = copies.select(slot).distinct(), docs.withColumn("_slot", slot)
    other = rows.join(F.broadcast(taken), "_slot", "left_semi").join(copies, "doc", "left_anti")
    return rows.join(F.broadcast(taken), "_slot", "left_anti").select("doc", "text").unionAll(other.select("doc", "text"))


def emit_keys(docs: DataFrame) -> DataFrame:
    """(key, doc, about: band and n) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            own, sizes = shingle_sets(binary(part, "text"))
            key, row, band = sketch_keys(own, sizes)
            doc = part.column(0).to_numpy(zero_copy_only=False)
            about = sizes[row] | band << 32  # one number in the shuffle
            yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(doc[row], pa.int64()), pa.array(about)], ["key", "doc", "about"])

    return docs.mapInArrow(run, "key long, doc long, about long")


def shared_keys(keys: DataFrame) -> DataFrame:
    """The keys that two documents have, with the number of documents: (key, doc, about, size).  A stream sorted by
    Spark; of a longer run than LONG, at most LONG rows are held, and LONG stands for its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        long = None

        def told(cols: list[np.ndarray], size: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.array(size)], ["key", "doc", "about", "size"])

        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if long is not None:
                k = int(np.searchsorted(cols[0], long, side="right"))
                yield told([c[:k] for c in cols], np.full(k, LONG))
                cols = [c[k:] for c in cols]
            if not len(cols[0]):
                continue
            long = None
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            begin = np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1]))
            many = np.diff(np.append(begin, len(cols[0])))
            size = np.repeat(np.minimum(many, LONG), many)
            if many[-1] >= LONG:
                long, held = cols[0][-1], [c[:0] for c in cols]
            else:
                held = [c[begin[-1] :] for c in cols]
                size[begin[-1] :] = 0
            keep = size > 1
            yield told([c[keep] for c in cols], size[keep])
        keep = np.full(len(held[0]), len(held[0]) > 1)
        yield told([c[keep] for c in held], np.full(int(keep.sum()), len(held[0])))

    return keys.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(run, "key long, doc long, about long, size long")


def by_band(f: Callable[[int], int]) -> Column:
    """f of the band in ``about``."""
    return F.array(*[F.lit(f(k)) for k in range(40)])[F.shiftright("about", 32).cast("int")]


def rare_keys(shared: DataFrame) -> DataFrame:
    """Each document without its ``spare`` most common keys; documents with fewer than ``overlap`` left have no partner."""
    own = Window.partitionBy("doc", "about")
    # keys that nobody shares are the least common ones: if fewer than the spare ones are shared, nothing is left
    rank, have = F.row_number().over(own.orderBy(F.col("size").desc(), F.col("key").desc())), F.count("*").over(own)
    rows = shared.withColumn("_rank", rank).withColumn("_have", have)
    rows = rows.where((F.col("_rank") > by_band(spare)) & (F.col("_have") >= by_band(spare) + by_band(overlap)))
    return rows.select("key", "doc", F.col("about").bitwiseAND((1 << 32) - 1).alias("n"))


def candidates(keys: DataFrame) -> DataFrame:
    """Pairs (a, b; key null) of documents of fitting sizes that share ``shared`` keys of at most FEW
    documents, out of ``need`` that a link takes; and for keys of more documents, each with the key's
    first: (key, a, b).  Runs are found in a stream sorted by Spark; a run of any length passes in bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3  # the last run, while it is short
        long: tuple[int, int] | None = None  # key and first document of a run that isn't
        # by size: overlap in the lowest band that a set of that size is in
        least = np.array([1] + [overlap(lowest_band(n)) for n in range(1, 2048)], np.int64)

        def told(key: np.ndarray | None, a: np.ndarray, b: np.ndarray, *counts: np.ndarray) -> pa.RecordBatch:
            none = pa.nulls(len(a), pa.int64())
            rest = [pa.array(x) for x in counts] or [none, none]
            return pa.RecordBatch.from_arrays([none if key is None else pa.array(key), pa.array(a), pa.array(b), *rest], ["key", "a", "b", "shared", "need"])

        def pairs(key: np.ndarray, doc: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            found = [np.empty((3, 0), np.int64)]
            for step in range(1, FEW):
                ok = (key[step:] == key[:-step]) & (doc[step:] != doc[:-step])
                x, y = n[step:], n[:-step]
                ok &= np.minimum(x, y) * 100 >= np.maximum(x, y) * PERCENT
                if ok.any():
                    found.append(np.stack([doc[:-step][ok], doc[step:][ok], least[np.minimum(np.maximum(x, y)[ok], 2047)]]))
            (a, b, need), shared = np.unique(np.concatenate(found, axis=1), axis=1, return_counts=True)
            return told(None, a, b, shared, need)

        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if long is not None:
                k = int(np.searchsorted(cols[0], long[0], side="right"))
                yield told(cols[0][:k], cols[1][:k], np.full(k, long[1]))
                cols = [c[k:] for c in cols]
            if not len(cols[0]):
                continue
            long = None
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            key, doc, n = cols
            begin = np.flatnonzero(np.diff(key, prepend=key[0] - 1) != 0)
            size = np.diff(np.append(begin, len(key)))
            last = begin[-1]
            big = np.repeat(size > FEW, size)
            if big.any():
                first = np.repeat(doc[begin], size)
                yield told(key[big], doc[big], first[big])
            if size[-1] > FEW:
                long, held = (key[-1], doc[last]), [c[:0] for c in cols]
            else:
                held = [c[last:] for c in cols]
                big[last:] = True  # not complete yet
            yield pairs(key[~big], doc[~big], n[~big])
        yield pairs(*held)

    return keys.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(run, "key long, a long, b long, shared long, need long")


def near_enough(pairs: DataFrame, base: DataFrame) -> DataFrame:
    """Pairs (a, b) that pass the bounds on size and on the Hamming distance of their sketches."""
    side = lambda x: base.select(F.col("doc").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where((F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT)).select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "s_a", "s_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x, y = (batch.column(i).to_pylist() for i in (2, 3, 4))
            keep = [distance(x[i], y[i]) * (100 + PERCENT) <= n[i] * (100 - PERCENT) for i in range(len(n))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets pass the threshold."""
    ids = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            own, sizes = shingle_sets(binary(part, "text"))
            ends = np.cumsum(sizes)
            found = [own[a:b].tobytes() for a, b in zip(ends - sizes, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["doc", "own"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= PERCENT * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    owned = materialize(slot_filter(docs, ids, ["doc"]).join(ids, "doc", "left_semi").mapInArrow(sets, "doc long, own binary"), "ngram-sets")
    b = owned.select(F.col("doc").alias("b"), F.col("own").alias("set_b"))
    a = owned.select(F.col("doc").alias("a"), F.col("own").alias("set_a"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "set_a", "set_b").mapInArrow(test, "a long, b long")


def best_partner(pairs: DataFrame) -> DataFrame:
    """Of the pairs (a, b) with repeats, for each b the a that it shares most keys with."""
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("_n"))
    return counted.groupBy("b").agg(F.max(F.struct("_n", -F.col("a"))).alias("_m")).select((-F.col("_m.col2")).alias("a"), "b")


def rest_pairs(mixed: DataFrame, few: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What may link through ``mixed``: the large keys (key, doc, comp, n, size) that hold several components.
    A pair has to share ``need`` keys.  Either some of them are small - then it is in ``few`` - and its
    two documents must have enough large ones for the rest: these pairs come first.  Or all are large, and then
    it shares one that isn't among the need - 1 most common of either document: these (key, doc, comp, n)
    come second."""
    tops = sorted({n for k in range(1, 12) for n in ((1 << k) - 1, ((1 << k) - 1) * 5 // 4)})
    lowest = F.expr("case " + " ".join(f"when n <= {top} then {overlap(lowest_band(top))}" for top in tops) + f" else {overlap(99)} end")
    rows = mixed.select("key", "doc", "comp", "n", "size", lowest.alias("need"))
    by_doc = Window.partitionBy("doc")
    rows = rows.withColumn("have", F.count("*").over(by_doc)).withColumn("rank", F.row_number().over(by_doc.orderBy("size", "key")))
    rows = materialize(rows, "ngram-rest")
    have = rows.select("doc", "have", "comp").distinct()
    a, b = (have.select(F.col("doc").alias(x), F.col("have").alias(f"h_{x}"), F.col("comp").alias(f"c_{x}")) for x in "ab")
    through = few.where("shared < need").join(a, "a").join(b, "b").where("c_a <> c_b and least(h_a, h_b) + shared >= need").select("a", "b")
    return through, rows.where("rank <= have - need + 1").select("key", "doc", "comp", "n")


def with_sketches(rows: DataFrame, base: DataFrame, block: int = BLOCK) -> DataFrame:
    """``rows`` (key, doc, comp, n) with sketch, block of the key (``at``) and the key's last block (``last``)."""
    order = Window.partitionBy("key").orderBy("doc")
    rows = rows.withColumn("at", F.expr(f"(row_number() over (partition by key order by doc) - 1) div {block}")).withColumn("last", F.max("at").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return materialize(rows.join(base.select("doc", "sketch"), "doc").select("key", "doc", "comp", "n", "at", "last", "sketch"), "ngram-sketched")


def near_within(rows: DataFrame, nearest: bool = False) -> DataFrame:
    """Pairs (a, b) of one key and different components that pass the bounds on size and sketches; ``nearest``:
    only each document's closest one.  ``rows`` are those of :func:`with_sketches`.  They are compared inside the task
    and only pairs that pass leave it.  A key of several blocks is dealt as pairs of them, so a task never holds more
    than two."""
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    rows = rows.select(F.xxhash64("key", F.least("at", "other"), F.greatest("at", "other")).alias("cell"), "key", F.least("at", "other").alias("x"), F.greatest("at", "other").alias("y"), "doc", "comp", "n", "sketch")

    def compare(doc: np.ndarray, comp: np.ndarray, n: np.ndarray, sketch: list[bytes]) -> list[np.ndarray]:
        size, folded = min(map(len, sketch)), []
        for x in sketch:
            bits = np.frombuffer(x, np.uint64)
            while len(bits) * 8 > size:
                bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
            folded.append(bits)
        bits, found = np.stack(folded), []
        order = np.argsort(n, kind="stable")
        doc, comp, n, bits = doc[order], comp[order], n[order], bits[order]
        stop = np.searchsorted(n * PERCENT, n * 100, side="right")  # sizes that fit
        closest, partner = np.full(len(n), np.inf), np.zeros(len(n), np.int64)
        for i in range(len(n) - 1):
            j = slice(i + 1, stop[i])
            far = np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64)
            ok = np.flatnonzero((far * (100 + PERCENT) <= (n[j] + n[i]) * (100 - PERCENT)) & (comp[j] != comp[i])) + i + 1
            if nearest and len(ok):
                gap = far[ok - i - 1] / (n[ok] + n[i])
                closer = gap < closest[ok]
                closest[ok[closer]], partner[ok[closer]] = gap[closer], i
                if gap.min() < closest[i]:
                    closest[i], partner[i] = gap.min(), ok[gap.argmin()]
            elif len(ok):
                found.append(np.stack([np.full(len(ok), doc[i]), doc[ok]]))
        if nearest:
            have = np.flatnonzero(np.isfinite(closest))
            found += [np.stack([doc[have], doc[partner[have]]])] if len(have) else []
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        found: list[np.ndarray] = []

        def close() -> None:
            if len(held) > 1:
                _, doc, comp, n, sketch = zip(*held, strict=True)
                found.extend(compare(np.array(doc), np.array(comp), np.array(n), list(sketch)))
            held.clear()

        for batch in batches:
            for key, x, y, doc, comp, n, sketch in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if held and held[0][0] != (key, x, y):
                    close()
                held.append(((key, x, y), doc, comp, n, sketch))
            if found:
                both = np.unique(np.concatenate(found, axis=1), axis=1)
                found.clear()
                yield pa.RecordBatch.from_arrays([pa.array(both.min(0)), pa.array(both.max(0))], ["a", "b"])
        close()
        both = np.concatenate([np.empty((2, 0), np.int64), *found], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(both.min(0)), pa.array(both.max(0))], ["a", "b"])

    dealt = rows.repartition("cell").sortWithinPartitions("cell", "key", "x", "y")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def relabelled(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """``rows`` with ``comp`` as ``changed`` (node, component) says."""
    told = rows.join(changed, F.col("comp") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "comp"))
    return told.select(*rows.columns)


def mixed_keys(rows: DataFrame) -> DataFrame:
    """Of ``rows`` (key, doc, comp, n) the keys of several components, with their size, their smallest component
    (``low``) and a document of it (``head``)."""
    told = rows.groupBy("key").agg(F.min(F.struct("comp", "doc")).alias("least"), F.max("comp").alias("high"), F.count("*").alias("size"))
    told = told.where("least.comp <> high").select("key", "size", F.col("least.comp").alias("low"), F.col("least.doc").alias("head"))
    return materialize(rows.join(told, "key").select(*rows.columns, "size", "low", "head"), "ngram-mixed")


def linked(docs: DataFrame) -> DataFrame:
    """``docs``: doc, text.  doc, n, comp of every row: components of the links, by one of their docs."""
    profiles = profile(docs)
    groups = profiles.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc").alias("rep"))
    base = materialize(profiles.join(groups, ["h1", "h2", "n"], "left").select("doc", "n", "rep", "sketch"), "ngram-base")
    reps = base.where("n > 0").select("doc", "rep", "n")
    of = base.where("doc = rep")
    found = materialize(candidates(rare_keys(shared_keys(emit_keys(representatives(docs, base))))), "ngram-candidates")
    shared = found.where("key is not null").select("key", F.col("a").alias("doc"), F.col("b").alias("first"))

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def near(pairs: DataFrame) -> DataFrame:
        return materialize(near_enough(materialize(ordered(pairs), "ngram-pairs"), of), "ngram-near")

    def exact(pairs: DataFrame) -> DataFrame:
        return materialize(verified(pairs, docs), "ngram-links")

    few = found.where("key is null").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("need").alias("need"))
    few = materialize(few, "ngram-few")
    # in large keys every document against its most frequent first one
    star = best_partner(shared.where("doc <> first").select(F.col("first").alias("a"), F.col("doc").alias("b")))
    pairs = few.where("shared >= need").select("a", "b").union(star.select("a", "b"))
    tested = near(pairs)
    links = exact(tested)
    copies = reps.where("doc <> rep").select(F.col("rep").alias("a"), F.col("doc").alias("b"))
    labels = components(links.unionAll(copies))
    comp = materialize(reps.join(labels, reps["rep"] == labels["node"], "left").select("doc", "rep", "n", F.coalesce("component", "rep").alias("comp")), "ngram-comp")

    label = comp.where("doc = rep").select("doc", "comp", "n").distinct()
    edges = changed = None  # between the components so far, and what becomes of those

    def add(pairs: DataFrame) -> bool:
        """Tests the pairs that weren't yet; ``changed`` says what their links make of the components."""
        nonlocal tested, edges, changed
        now = materialize(ordered(pairs).join(tested, ["a", "b"], "left_anti"), "ngram-untested")
        more, tested = exact(now), tested.unionAll(now)
        if more.isEmpty():
            return False
        ends = more.join(label, F.col("a") == F.col("doc")).select("b", F.col("comp").alias("to"))
        ends = ends.join(label, F.col("b") == F.col("doc")).select(F.col("to").alias("a"), F.col("comp").alias("b"))
        edges = ends if edges is None else edges.unionAll(ends)
        changed = components(edges).where("node <> component")
        return True

    # a key holds several components if one of its documents is in another one than its first: seen by the
    # pairs of document and first, of which there are far fewer than rows, and only such keys are read on
    both = shared.select("doc", "first").distinct().join(label, "doc")
    both = both.join(label.select(F.col("doc").alias("first"), F.col("comp").alias("other")), "first")
    apart = both.where("comp <> other").select("doc", "first")
    keys = shared.join(apart, ["doc", "first"]).select("key").distinct()
    rows = shared.join(keys, "key", "left_semi").join(label, "doc").select("key", "doc", "comp", "n")
    mixed = mixed_keys(materialize(rows, "ngram-rows-mixed"))
    if not mixed.isEmpty():
        # against a document of the key's smallest component
        if add(near(best_partner(mixed.where("comp <> low").select(F.col("head").alias("a"), F.col("doc").alias("b"))))):
            mixed = mixed_keys(materialize(relabelled(mixed.select("key", "doc", "comp", "n"), changed), "ngram-rows-mixed"))
        through, rows = rest_pairs(mixed, few)
        rows = with_sketches(rows, of)
        # against the closest one, so that a group of near copies is one component before its pairs are listed
        if add(near(through).union(near_within(rows, nearest=True))):
            rows = relabelled(rows, changed)
        add(near_within(rows))
    if changed is not None:
        comp = relabelled(comp, changed)
    return base.select("doc", "n").join(comp.select("doc", "comp").distinct(), "doc", "left").select("doc", "n", F.coalesce("comp", "doc").alias("comp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc (null ids stand last), n_shingles, component_id: one row per row of ``docs``."""
    docs = nodes(docs.select(id_col().alias("id"), F.col("text").cast("string").alias("text")))
    found = linked(docs.select("doc", "text"))
    ids = docs.where("doc <> id").select("doc", "id").distinct()
    rows = found.join(ids, "doc", "left").select(F.coalesce("id", "doc").alias("doc"), "n", "comp")
    rows = materialize(rows, "ngram-rows")
    # the texts of one id join their components; those without a word are linked with nothing
    own = rows.where("n > 0").groupBy("doc").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    joined = components(rows.where("n > 0").join(own, "doc").select(F.col("low").alias("a"), F.col("comp").alias("b")))
    full = rows.where("n > 0").join(joined, F.col("comp") == F.col("node"), "left").select("doc", "n", F.coalesce("component", "comp").alias("comp"))
    least = full.groupBy("comp").agg(F.min("doc").alias("component_id"))
    found = full.join(least, "comp").select("doc", F.col("n").alias("n_shingles"), "component_id")
    return found.unionAll(rows.where("n = 0").select("doc", F.col("n").alias("n_shingles"), F.col("doc").alias("component_id")))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(id_back("doc").alias("doc_id"), "n_shingles", id_back("component_id").alias("component_id"))


QUERIES = {"op4_ngram_join": op4_ngram_join}
#: All pairs of shingle sets are too slow in SQL on whole tables: tested against brute force.
ORACLE: dict[str, str] = {}

"""Document fingerprints: canonical exact digest.  Native: DataFrame and SQL functions only.

Canonical form: Unicode NFKC, full case folding, NFKC again (folding can denormalise), runs of white
space to one blank, ends trimmed.  Two xxhash64 values with different seeds make a 128-bit bucket;
inside buckets with more than one member the canonical bytes are compared, and texts that differ
although their hashes agree get an ordinal appended.  Buckets are aggregated with map-side combine
(smallest and largest canonical bytes), so a group of copies never meets in one task.

Normalisation and folding call the ICU library that Spark ships through SQL's ``reflect``: they run
in the JVM, inside the plan.

Defined cases: null text is the empty text; null ids order last; repeated rows each give a row; the
document after the last is the first; one document alone is its own successor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LAST_ID, id_back, id_col, materialize, read, slot_filter

#: White space as Unicode's White_Space property has it.
SPACE = r"[\u0009-\u000D \u0085   -     　]+"
#: About so many rows a block, and so many blocks at most: with more rows, blocks grow instead.
ROWS_A_BLOCK = 4096
BLOCKS = 1 << 16


def canonical(text: Column) -> Column:
    """NFKC, case fold, NFKC, one blank for each run of white space, trimmed."""
    nfkc = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = lambda c: F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    return F.trim(F.regexp_replace(nfkc(fold(nfkc(text))), SPACE, " "))


def bucket(canon: Column) -> Column:
    """128 bits: two xxhash64 values, the second over the reversed text after a salt."""
    return F.concat(F.lower(F.lpad(F.hex(F.xxhash64(canon)), 16, "0")), F.lower(F.lpad(F.hex(F.xxhash64(F.lit("docgrid"), canon)), 16, "0")))


def with_blocks(docs: DataFrame) -> DataFrame:
    """``docs`` (_id, text) with _block, in the order of (_id, text): arrays of numbers that order as their blocks do.

    A block of many rows is cut into ranges of equal width between its lowest and highest key, and those that still have
    many again, so that ids far from the others, or crowded together, don't make a large block.  The key is the id; of
    rows without an id the first seven bytes of the text.  Only blocks of one key stay large.  There are about as many
    cuts as blocks, at most some BLOCKS, so their broadcast is bounded.
    """
    n, nulls = docs.agg(F.count("*"), F.coalesce(F.sum((F.col("_id") == LAST_ID).cast("long")), F.lit(0))).first()
    most = max(ROWS_A_BLOCK, n // BLOCKS)
    none = F.col("_id") == LAST_ID
    # texts are read for their keys only if rows lack an id
    start = F.conv(F.rpad(F.hex(F.substring(F.encode("text", "UTF-8"), 1, 7)), 14, "0"), 16, 10) if nulls else F.lit(0)
    key = F.when(none, start.cast("decimal(20, 0)")).otherwise(F.col("_id").cast("decimal(20, 0)"))
    docs = docs.withColumn("_key", key).withColumn("_block", F.array(none.cast("long")))
    while True:
        cut = docs.groupBy("_block").agg(F.count("*").alias("n"), F.min("_key").alias("_low"), F.max("_key").alias("_high")).where((F.col("n") > 2 * most) & (F.col("_low") < F.col("_high")))
        width = F.floor((F.col("_high") - F.col("_low")) / F.ceil(F.col("n") / most)).cast("decimal(20, 0)") + 1
        cut = materialize(cut.select("_block", "_low", width.cast("decimal(20, 0)").alias("_width")), "fp-cuts")
        if cut.isEmpty():
            return docs.drop("_key")
        part = F.floor((F.col("_key") - F.col("_low")) / F.col("_width")).cast("long")
        docs = docs.join(F.broadcast(cut), "_block", "left").withColumn("_block", F.when(F.col("_low").isNull(), F.col("_block")).otherwise(F.concat("_block", F.array(part)))).drop("_low", "_width")


def successors(docs: DataFrame, digest=bucket) -> DataFrame:
    """_id, text, own and the same of the row that follows in order of (_id, text): next_id,
    next_text, next_own.

    Blocks of ids stand in for a global window: a lead inside each block, which is closed by a copy of
    the first row of the next block that has any.
    """
    docs = with_blocks(docs.select(id_col().alias("_id"), F.coalesce("text", F.lit("")).alias("text")))
    # the first row of each block, one for about ROWS_A_BLOCK documents, also closes the block before it
    firsts = materialize(docs.groupBy("_block").agg(F.min(F.struct("_id", "text")).alias("_first")).select("_block", "_first.*"), "fp-firsts")
    before = F.lag("_block").over(Window.orderBy("_block"))
    last = firsts.agg(F.max("_block")).first()[0] or [0]
    closing = firsts.select("_block").withColumn("_to", F.coalesce(before, F.array(*[F.lit(x).cast("long") for x in last])))
    closing = firsts.join(closing, "_block").select("_id", "text", F.col("_to").alias("_block"), F.lit(True).alias("_closes"))
    rows = docs.withColumn("_closes", F.lit(False)).unionByName(closing).withColumn("own", digest(canonical(F.col("text"))))
    order = Window.partitionBy("_block").orderBy("_closes", "_id", "text")
    led = rows.withColumn("_next", F.lead(F.struct("_id", "text", "own")).over(order)).where("not _closes")
    return led.select("_id", "text", "own", F.col("_next._id").alias("next_id"), F.col("_next.text").alias("next_text"), F.col("_next.own").alias("next_own"))


def edited_text(text: Column, following: Column) -> Column:
    """The last floor(n/2) code points replaced by the first as many (or all) of ``following``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(following, half))


def conflicts(rows: DataFrame, docs: DataFrame, digest=bucket) -> DataFrame:
    """Byte comparison inside equal buckets.  Texts are fetched for rows only whose own or edited
    bucket has another member; a bucket whose smallest and largest canonical bytes differ holds
    different texts, whose members get an ordinal above 0 after the smallest text:
    _id, _text, _following, edited, ordinal.  Empty unless 128 bits collide."""
    items = rows.select(F.col("own").alias("bucket")).unionAll(rows.select(F.col("edit").alias("bucket")))
    shared = materialize(items.groupBy("bucket").count().where("count > 1").select("bucket"), "fp-shared")
    key = ["_id", "_text", "next_id", "_following"]
    wanted = rows.select(*key, F.col("own").alias("bucket"), F.lit(False).alias("edited")).unionAll(
        rows.select(*key, F.col("edit").alias("bucket"), F.lit(True).alias("edited"))
    ).join(shared, "bucket", "left_semi").distinct()
    wanted = materialize(wanted, "fp-wanted")
    ids = wanted.select("_id", "_text").union(wanted.where("edited").select("next_id", "_following")).distinct()
    texts = docs.select(id_col().alias("_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_text", F.xxhash64("text"))
    texts = slot_filter(texts, ids, ["_id", "_text"])
    texts = materialize(texts.join(ids, ["_id", "_text"], "left_semi").dropDuplicates(["_id", "_text"]), "fp-texts")
    follow = texts.select(F.col("_id").alias("next_id"), F.col("_text").alias("_following"), F.col("text").alias("next_text"))
    own = wanted.where("not edited").join(texts, ["_id", "_text"])
    changed = wanted.where("edited").join(texts, ["_id", "_text"]).join(follow, ["next_id", "_following"])
    members = own.withColumn("canon", canonical(F.col("text"))).drop("text").unionByName(
        changed.withColumn("canon", canonical(edited_text(F.col("text"), F.col("next_text")))).drop("text", "next_text")
    )
    mixed = members.groupBy("bucket").agg(F.min("canon").alias("_low"), F.max("canon").alias("_high")).where("_low <> _high")
    mixed = materialize(mixed.select("bucket"), "fp-mixed")
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy("canon"))
    if mixed.isEmpty():
        return mixed.sparkSession.createDataFrame([], "_id long, _text long, next_id long, _following long, edited boolean, ordinal int")
    ranked = members.join(mixed, "bucket", "left_semi").withColumn("ordinal", rank - 1)
    return materialize(ranked.where("ordinal > 0").select(*key, "edited", "ordinal"), "fp-ranked")


def fingerprints(docs: DataFrame, digest=bucket) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  Likeness is 1 for equal fingerprints, else 0: the digest is exact.
    ``digest`` maps a canonical column to a bucket string (tests pass a weak one to force collisions).
    """
    changed = successors(docs, digest).withColumn("_edited", edited_text(F.col("text"), F.col("next_text")))
    rows = materialize(
        changed.select(
            "_id",
            "next_id",
            F.xxhash64("text").alias("_text"),
            F.xxhash64("next_text").alias("_following"),
            F.length("text").cast("long").alias("n_chars"),
            F.sha2("_edited", 256).alias("edited_sha256"),
            "own",
            digest(canonical(F.col("_edited"))).alias("edit"),
            "next_own",
        ),
        "fp-rows",
    )
    clash = conflicts(rows, docs, digest)
    own, edit, nxt = F.col("own"), F.col("edit"), F.col("next_own")
    if not clash.isEmpty():
        key = ["_id", "_text", "next_id", "_following"]
        mine = clash.where("not edited").select("_id", "_text", F.col("ordinal").alias("_o")).distinct()
        theirs = mine.select(F.col("_id").alias("next_id"), F.col("_text").alias("_following"), F.col("_o").alias("_n"))
        rows = rows.join(mine, ["_id", "_text"], "left").join(theirs, ["next_id", "_following"], "left")
        rows = rows.join(clash.where("edited").select(*key, F.col("ordinal").alias("_e")), key, "left")
        tail = lambda c: F.when(F.col(c).isNull(), F.lit("")).otherwise(F.concat(F.lit("-"), F.col(c).cast("string")))
        own, edit, nxt = F.concat(own, tail("_o")), F.concat(edit, tail("_e")), F.concat(nxt, tail("_n"))
    return rows.select(
        id_back("_id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        own.alias("fingerprint"),
        edit.alias("edited_fingerprint"),
        (own == edit).cast("double").alias("near_edited"),
        (own == nxt).cast("double").alias("near_next"),
    )


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))


QUERIES = {"op10_fingerprint": op10_fingerprint}
#: ICU's folding and xxhash have no counterpart in SQL there: tested against a brute-force version.
ORACLE: dict[str, str] = {}

"""Shared plumbing of the training-data operators: scratch tables, ids, token arrays, hashing.

Scratch tables are Parquet under ``spark.checkpoint.dir`` (the folder that a cluster shares between
its driver and executors).  They cut lineage, so a lost executor never forces more than one step to
be redone, and they are removed when the application ends or when :func:`release` is called.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Internal stand-in for a null id: nulls order after every real id.
LAST_ID = (1 << 63) - 1

_scratch: dict[str, list[tuple[SparkSession, str]]] = {}
_scope = ["app"]


#: Rows and bytes of an Arrow batch at most: batches pass whole through the JVM, Arrow and Python, several at a time.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds of Arrow batches to :data:`BATCH`; lower ones stay."""
    for key, most in BATCH.items():
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``; only where that is
    unset (tests) a local folder is made and set."""
    small_batches(spark)
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jsc.get() if jsc.isDefined() else None
    if not found:
        import tempfile

        found = tempfile.mkdtemp(prefix="docgrid-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted with its scope."""
    path = f"{shared_dir(spark)}/docgrid-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _scratch.setdefault(_scope[-1], []).append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(scope: str = "app") -> None:
    """Delete a scope's scratch tables; frames that still read them become invalid."""
    for spark, path in _scratch.pop(scope, []):
        with contextlib.suppress(Exception):  # the session may have ended meanwhile
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def scope(name: str) -> Iterator[None]:
    """Scratch tables made inside belong to ``name`` and go with ``release(name)``."""
    _scope.append(name)
    try:
        yield
    finally:
        _scope.pop()


def _at_exit() -> None:
    for name in list(_scratch):
        release(name)


atexit.register(_at_exit)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_col(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST_ID))


def id_back(name: str) -> Column:
    """The caller's id again: the stand-in becomes null."""
    return F.when(F.col(name) != LAST_ID, F.col(name))


#: Slots of :func:`slot_filter`; its broadcast has at most so many numbers, whatever the data.
SLOTS = 1 << 20


def slot_filter(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose key's hash slot holds any of ``keys``: a superset of the exact semi-join, cut
    down before texts are shuffled.  When there are more keys than slots it lets all pass; the join that
    follows decides."""
    slot = F.pmod(F.xxhash64(*on), F.lit(SLOTS)).alias("_slot")
    taken = keys.select(slot).distinct()
    return rows.withColumn("_slot", slot).join(F.broadcast(taken), "_slot", "left_semi").drop("_slot")


# ---------------------------------------------------------------------------------------------
# token arrays


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_ODD = mix(np.arange(1, 129, dtype=np.uint64)) | np.uint64(1)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
STRETCH = 1 << 20


def _power(n: int) -> list[np.ndarray]:
    """_BASE ** i and its inverse modulo 2 ** 64, for i below n at least."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without ASCII white space) of all texts end to end, and the number of words of
    each.  A polynomial over the bytes, by running sums, so there is no work per word in Python; sums are
    taken over stretches of about a megabyte that end between words, so memory doesn't follow the text."""
    data = np.frombuffer(b"\n".join([*(x or b"" for x in texts), b""]), np.uint8)
    sizes = np.array([len(x or b"") for x in texts], np.int64)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[::2], edge[1::2]
    out = np.empty(len(start), np.uint64)
    k = 0
    while k < len(start):
        stop = max(k + 1, int(np.searchsorted(end, start[k] + STRETCH, side="right")))
        a, b = start[k], end[stop - 1]
        power, inverse = _power(int(b - a) + 1)
        sums = np.empty(b - a + 1, np.uint64)
        sums[0] = 0
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * power[: b - a], out=sums[1:])
        out[k:stop] = (sums[end[k:stop] - a] - sums[start[k:stop] - a]) * inverse[start[k:stop] - a]
        k = stop
    offsets = np.cumsum(sizes + 1) - (sizes + 1)
    return mix(out), np.diff(np.searchsorted(start, np.append(offsets, len(data))))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes (empty when there are fewer)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out += words[i : i + m] * _ODD[i]
    return mix(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column, or a field of one: ``a.b``."""
    first, *rest = name.split(".")
    out = batch.column(batch.schema.get_field_index(first))
    for x in rest:
        out = pc.struct_field(out, x)
    return out


def trim() -> None:
    """Gives memory that is free back to the system: Python's workers are reused, and would keep their peaks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], name: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each, so that Python lists of words
    stay small however many rows a batch has.  One long text is one slice: texts are never cut."""
    for batch in batches:
        col = column(batch, name)
        size = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
        ends, start, total = size.cumsum(), 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, total + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, total = stop, int(ends[stop - 1])
        del batch, col
        trim()


def binary(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """The UTF-8 bytes of a text column."""
    col = column(batch, name)
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()

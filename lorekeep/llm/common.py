"""Shared helpers: durable intermediate tables and byte-level tokenisation in Arrow."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and leaves every other byte alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_made: dict[str, SparkSession] = {}
_local = ""


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a temporary one serves a single machine, and no other."""
    global _local
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    _local = _local or "file://" + tempfile.mkdtemp(prefix="lorekeep-")
    return _local


def stored(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut, and a lost executor loses nothing.

    The table lasts until it is released, or the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lorekeep-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    spark._jvm.System.gc()  # lets Spark drop the shuffle files of plans that are done with
    out = spark.read.schema(df.schema).parquet(path)
    _made[path] = spark
    out._stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete stored tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path in _made:
            _delete(_made.pop(path), path)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s rows, stored; tables that were stored for them are released."""
    before = set(_made)
    out = stored(make())
    for path in [p for p in _made if p not in before and p != out._stored_at]:
        _delete(_made.pop(path), path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    for path, spark in _made.items():
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: whoever owns the shared folder clears it
            return


atexit.register(_clean)


#: Rows that cross to a Python worker at once: whole texts are long, and the JVM holds a batch outside its heap.
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int):
    """crc32 of the value as text, modulo n; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def slices(batches, text: int = 1, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of each hold about limit bytes: bounded memory at any batch size."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield b.slice(at, to - at)
            at = to


def texts_of(column: pa.Array, by: bytes | None = None) -> pa.Array:
    """Strings without nulls (a null becomes empty); by maps each byte of all texts at once."""
    a = pc.fill_null(column, "")
    a = pa.concat_arrays([a]) if a.offset == 0 else pa.concat_arrays([a.slice(0)])
    if by is None or not len(a):
        return a
    _, offsets, data = a.buffers()
    return pa.StringArray.from_buffers(len(a), offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(by)), offset=a.offset)


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space, in order, of all texts; and how many each text has."""
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    row = pc.list_parent_indices(parts).to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(full).as_py():
        row, flat = row[full.to_numpy(zero_copy_only=False)], flat.filter(full)
    return flat, np.bincount(row, minlength=len(texts)).astype(np.int64)


#: A random value for each byte but white space; hashes of words are sums of these times powers of _BASE, modulo 2^64.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE = np.where(_SPACE, np.uint64(0), np.random.default_rng(20).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1))
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    """The first n powers of _BASE and of its inverse."""
    if len(_powers[0]) < n:
        for k, x in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]), dtype=np.uint64)
    return _powers


def mixed(h: np.ndarray, by: int = 0xBF58476D1CE4E5B9) -> np.ndarray:
    """Well spread 64-bit values."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(by)
    return h ^ (h >> np.uint64(32))


class Words:
    """Words between ASCII white space of some texts without nulls: where they start and end in the bytes of all, and of which text they are."""

    def __init__(self, texts: pa.StringArray):
        _, offsets, data = texts.buffers()
        n = len(texts)
        self.offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        low, high = int(self.offsets[0]), int(self.offsets[-1])
        self.bytes = np.frombuffer(data, np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
        self.offsets = self.offsets - low
        full = np.zeros(len(self.bytes) + 2, bool)
        full[1:-1] = ~_SPACE[self.bytes]
        edge = np.zeros(len(self.bytes) + 1, bool)
        edge[self.offsets] = True
        self.start = np.flatnonzero(full[1:] & (~full[:-1] | edge))
        self.end = np.flatnonzero(full[:-1] & (~full[1:] | edge))
        self.counts = np.diff(np.searchsorted(self.start, self.offsets))
        self.row = np.repeat(np.arange(n), self.counts)

    def hashes(self, at_once: int = 1 << 18) -> np.ndarray:
        """A 64-bit hash of each word, about at_once bytes at a time."""
        out, i = np.empty(len(self.start), np.uint64), 0
        while i < len(out):
            low = int(self.start[i])
            j = max(i + 1, int(np.searchsorted(self.end, low + at_once, "right")))
            high = int(self.end[j - 1])
            power, back = _powers_to(max(high - low, at_once))
            begin = self.start[i:j] - low
            out[i:j] = np.add.reduceat(_BYTE[self.bytes[low:high]] * power[: high - low], begin) * back[begin]
            i = j
        return mixed(out + (self.end - self.start).astype(np.uint64))


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Offsets of consecutive groups of these sizes, and the end of the last."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

"""Shared folder, block files, and vectorised text primitives used by several operators."""

from __future__ import annotations

import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the vectorised loops; arrays of eight bytes a text byte stay small.
CHUNK = 1 << 18
#: Splitting characters of words: space and \t \n \v \f \r.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


# ---------------------------------------------------------------- shared folder
def shared_base(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one is made, on one machine only:
    on a cluster every executor would have its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="wickframe-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_base(spark)}/wickframe/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, read again.  A lost executor costs nothing of it.
    parts: files at most, for tables whose size is known to need no more; small ones would else have a file, and later
    a task with its own shuffle files, for each shuffle partition."""
    path = shared_path(df.sparkSession, name)
    (df.coalesce(parts) if parts else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once nothing will read them again: their successors are written."""
    from pyarrow import fs

    for df in tables:
        if files := df.inputFiles():
            store, path = fs.FileSystem.from_uri(files[0].rsplit("/", 1)[0])
            store.delete_dir(path)


def put_file(folder: str, name: str, data: bytes) -> None:
    """Writes whole files only: under another name first, then renamed."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    part = f"{root}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part, compression=None) as out:
        out.write(data)
    store.move(part, f"{root}/{name}")


def get_file(folder: str, name: str) -> bytes:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/{name}") as f:
        return f.read()


def trim() -> None:
    """Gives freed memory back to the system: a Python worker lives on and shares its executor's memory."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def forget() -> None:
    """Drops what a worker has kept of another operator (an encoder's cache) or task, which would count beside this one."""
    import gc
    import sys

    if (kept := sys.modules.pop("_wickframe_worker", None)) is not None:
        kept.__dict__.clear()
        gc.unfreeze()
        gc.collect()
    trim()


# ---------------------------------------------------------------- columns
def dealt(df: DataFrame, n: int) -> DataFrame:
    """Fragment f of n (the column key) as partition f, one to each task: by a hash of the key, some tasks would hold
    several at once.  Larger keys, of rows that only pass through, are dealt over all."""
    return df.repartitionById(n, F.pmod("key", F.lit(n)).cast("int"))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, whatever else the table has (first of those with equal names, without regard to case)."""
    have = [c.lower() for c in df.columns]
    fresh = df.toDF(*[f"c{i}" for i in range(len(have))])
    return fresh.select(*[F.col(f"c{have.index(n.lower())}").alias(n) for n in names])


def let(value: Column, fn) -> Column:
    """fn(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


# ---------------------------------------------------------------- text as bytes
def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in one array, and each text's start (and the end of the last). Null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def runs(offsets: np.ndarray, most: int = CHUNK):
    """Ranges [i, j) of texts with at most that many bytes together, or of one text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
_BYTE = odd(7, 256)
_R = np.uint64(0xD1342543DE82EF95)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and its inverse, modulo 2**64, for i below n."""
    if len(_POWERS.get("p", ())) < n:
        size = 1 << max(18, int(n).bit_length())
        inverse = np.uint64(pow(int(_R), -1, 1 << 64))
        for key, base in (("p", _R), ("q", inverse)):
            out = np.ones(1, np.uint64)
            step = base
            while len(out) < size:
                out = np.concatenate([out, out * step])
                step = step * step
            _POWERS[key] = out
    return _POWERS["p"], _POWERS["q"]


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = LOWER, outside: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text (runs of bytes that aren't outside: by default other than SPACES; A-Z as a-z, if fold says
    so): a 64-bit hash each, where each starts (index in data), and for each text the index of its first word (and the
    end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    with np.errstate(over="ignore"):
        inside = ~outside[data]
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = inside[:-1]
        before[offsets[:-1][offsets[:-1] < n]] = False  # a text's first byte follows nothing
        starts = np.flatnonzero(inside & ~before)
        first = np.searchsorted(starts, offsets)
        if not len(starts):
            return np.zeros(0, np.uint64), starts, first
        p, q = powers(n)
        terms = _BYTE[fold[data]] * p[:n]
        terms[~inside] = 0
        sums = np.add.reduceat(terms, starts)
        return mix(sums * q[starts]), starts, first


def pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def crc_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes()) & 0xFFFFFFFF

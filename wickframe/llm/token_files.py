"""Token-id files: independent zstandard frames with a trailing seek table and per-frame checksums.

Layout of a file: frames, each holding the little-endian unsigned 32-bit ids of whole documents; a skippable frame
(magic 0x184D2A5D) with a row for each document (doc_id int64, uint8 that is 1 if there is none, frame uint32, first id
in its frame uint64, number of ids uint64), and further ones if a file has more documents than one can list; a skippable frame (magic 0x184D2A5E) with the seek table of the public zstandard seekable format:
for each frame its compressed size, decompressed size and the low 32 bits of the XXH64 of its contents, then the
number of frames, a descriptor byte with the checksum flag, and the magic 0x8F92EAB1.  A reader seeks to the end,
reads the table, and decompresses only the frames of the documents asked for.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wickframe.llm.common import crc_ids, only, shared_path, trim, written
from wickframe.llm.tokens import Encoder, batches, default_path

#: Bytes of ids after which a frame is closed.
FRAME = 1 << 18
DOCS_MAGIC, TABLE_MAGIC, END_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
_DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("at", "<u8"), ("n", "<u8")])
#: Documents in a skippable frame, whose size has 32 bits.
DOC_ROWS = 1 << 24
_SEEK = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])


class CorruptFile(ValueError):
    """A frame's contents don't match its checksum, or the file has no seek table."""


class Writer:
    """Writes one file to an output stream, a document at a time."""

    def __init__(self, out, level: int = 1, frame: int = FRAME):
        import xxhash
        import zstandard

        self._pack, self._hash = zstandard.ZstdCompressor(level=level, write_checksum=True).compress, xxhash.xxh64_intdigest
        self._out, self._frame, self._held, self._size = out, frame, [], 0
        self._docs, self._seek = [], []
        self.n_ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._docs.append((doc_id or 0, doc_id is None, len(self._seek), self._size // 4, len(ids)))
        self._held.append(ids.astype("<u4", copy=False).tobytes())
        self._size += 4 * len(ids)
        self.n_ids += len(ids)
        if self._size >= self._frame:
            self._close_frame()

    def _close_frame(self) -> None:
        plain = b"".join(self._held)
        packed = self._pack(plain)
        self._out.write(packed)
        self._seek.append((len(packed), len(plain), self._hash(plain) & 0xFFFFFFFF))
        self._held, self._size = [], 0

    def close(self) -> None:
        if self._held:
            self._close_frame()
        for i in range(0, max(1, len(self._docs)), DOC_ROWS):
            docs = np.array(self._docs[i : i + DOC_ROWS], _DOC).tobytes()
            self._out.write(struct.pack("<II", DOCS_MAGIC, len(docs)) + docs)
        table = np.array(self._seek, _SEEK).tobytes() + struct.pack("<IBI", len(self._seek), 0x80, END_MAGIC)
        self._out.write(struct.pack("<II", TABLE_MAGIC, len(table)) + table)


class Reader:
    """Reads documents of one seekable file; decompresses a frame only when a document of it is asked for."""

    def __init__(self, file):
        self._f, end = file, file.size()
        file.seek(end - 9)
        frames, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != END_MAGIC:
            raise CorruptFile("no seek table")
        file.seek(end - 9 - frames * _SEEK.itemsize)
        self.seek = np.frombuffer(file.read(frames * _SEEK.itemsize), _SEEK)
        self.at = np.concatenate([[0], np.cumsum(self.seek["packed"], dtype=np.int64)])
        file.seek(int(self.at[-1]))
        rows = []
        while True:
            magic, size = struct.unpack("<II", file.read(8))
            if magic != DOCS_MAGIC:
                break
            rows.append(np.frombuffer(file.read(size), _DOC))
        if not rows or magic != TABLE_MAGIC:
            raise CorruptFile("no document table")
        self.docs = np.concatenate(rows)
        self.frames_read, self._last = 0, (-1, None)

    def _frame(self, k: int) -> np.ndarray:
        import xxhash
        import zstandard

        if self._last[0] != k:
            self._f.seek(int(self.at[k]))
            try:
                plain = zstandard.ZstdDecompressor().decompress(self._f.read(int(self.seek["packed"][k])), max_output_size=int(self.seek["plain"][k]))
            except zstandard.ZstdError as e:
                raise CorruptFile(f"frame {k}: {e}") from e
            if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.seek["check"][k]:
                raise CorruptFile(f"frame {k}: checksum")
            self._last, self.frames_read = (k, np.frombuffer(plain, "<u4")), self.frames_read + 1
        return self._last[1]

    def ids(self, row: int) -> np.ndarray:
        d = self.docs[row]
        return self._frame(int(d["frame"]))[int(d["at"]) : int(d["at"] + d["n"])]

    def find(self, doc_id: int) -> list[np.ndarray]:
        """All documents of that id."""
        return [self.ids(i) for i in np.flatnonzero((self.docs["doc_id"] == doc_id) & (self.docs["null"] == 0))]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int | None = 0, level: int = 1) -> DataFrame:
    """Writes the ids of each whole text, and end_id after it, into files of folder, in ascending doc_id (null first;
    equal ids by a hash of the text).  Null and empty texts give the end id only.  Returns the manifest, a table in the shared
    folder: part (ascending with doc_id), file, n_docs, n_ids, start (ids in the files before).  A file counts only
    if the manifest lists it: what a lost task left behind is never read."""
    path = tokenizer or default_path()
    rows = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    order = ("doc_id", F.xxhash64("text"))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    end = np.array([] if end_id is None else [end_id], np.uint32)

    def write(parts):
        from pyarrow import fs
        from pyspark import TaskContext

        encoder, store = Encoder.of_worker(path), fs.FileSystem.from_uri(folder)
        k, name, writer, out, n = TaskContext.get().partitionId(), f"ids-{uuid.uuid4().hex}.tok", None, None, 0
        for batch in parts:
            if batch.num_rows and writer is None:
                store[0].create_dir(store[1], recursive=True)
                out = store[0].open_output_stream(f"{store[1]}/{name}", compression=None)
                writer = Writer(out, level)
            for ids, texts in batches(batch):
                for doc_id, x in zip(ids, encoder.encode(texts), strict=True):
                    writer.add(doc_id, np.concatenate([x, end]))
                trim()
            n += batch.num_rows
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [k], "file": [name], "n_docs": [n], "n_ids": [writer.n_ids]}, pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    manifest = written(ordered.mapInArrow(write, "part int, file string, n_docs long, n_ids long"), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that the manifest lists."""
    spark = manifest.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def read(parts):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in parts:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as f:
                    r = Reader(f)
                    d, crc = r.docs, [crc_ids(r.ids(i)) for i in range(len(r.docs))]
                counts = d["n"].astype(np.int64)
                at = start + np.cumsum(counts) - counts
                yield pa.RecordBatch.from_arrays([pa.array(d["doc_id"].astype(np.int64), mask=d["null"].astype(bool)), pa.array(at), pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("file", "start").repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: writes all documents with end id 0 and returns what the files hold."""
    folder = shared_path(spark, "token-files")
    return read_token_files(write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder), folder)

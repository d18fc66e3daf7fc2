"""Removal of repeated passages of words: every word of a window of `window` words that starts earlier as well.

Anchors are runs of words at the places of a difference cover: the residues COVERS[v] modulo v hold two of every
difference, so of any two places some common shift below v takes both onto the cover.  Equal windows therefore share an
anchor of window - v + 1 words at the same place within them, wherever they stand in their texts.

1. Texts go to block files in the shared folder; only the list of blocks is a table.
2. Each block sends its distinct anchors; those that occur once anywhere end here.
3. A block extends its repeated anchors to the windows that hold them.  A window that starts earlier in the same block
   goes at once; of the others each block sends one row, so a passage that a third of all texts hold is a row a block.
4. Equal windows of different blocks meet; all but that of the smallest doc_id go.

Windows are equal if 128 bits of their words' hashes are.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wickframe.llm.common import IS_SPACE, SAME, forget, get_file, mix, odd, only, pack, put_file, runs, shared_path, trim, utf8, word_hashes, written

WINDOW = 20
#: Perfect difference covers: residues by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9)}
#: Words that an anchor should have at least, if windows are long enough.
ANCHOR = 8
#: Bytes of text in a block file.
BLOCK = 4 << 20


def period_for(window: int) -> int:
    """The longest period that leaves anchors of ANCHOR words."""
    return max((v for v in COVERS if window - v + 1 >= ANCHOR), default=1)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, unchanged, and for each text the index of its first word (and the end)."""
    hashes, first = [], [np.zeros(1, np.int64)]
    n = 0
    for i, j in runs(offsets):
        h, _, at = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SAME)
        hashes.append(h)
        first.append(n + at[1:])
        n += len(h)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(first)


def run_hashes(h: np.ndarray, at: np.ndarray, words: int, seed: int) -> np.ndarray:
    """A hash of the run of so many words from each place in `at` on."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(at), np.uint64)
        for k, m in enumerate(odd(seed, words)):
            total += h[at + k] * m
        return mix(total)


def cover_places(first: np.ndarray, window: int) -> np.ndarray:
    """Places of anchors: on the cover, counted from their text's first word, in texts that hold a window."""
    v = period_for(window)
    on = np.zeros(v, bool)
    on[list(COVERS[v])] = True
    n = np.diff(first)
    of = np.repeat(np.arange(len(n)), n)
    local = np.arange(first[-1]) - first[:-1][of]
    return np.flatnonzero(on[local % v] & (local + window - v + 1 <= n[of]) & (n[of] >= window))


def window_places(p: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Ascending places of all windows that hold an anchor at one of the places p."""
    v = period_for(window)
    of = np.searchsorted(first, p, "right") - 1
    start = (p[:, None] - np.arange(v)).ravel()
    of = np.repeat(of, v)
    fits = (start >= first[of]) & (start + window <= first[of + 1])
    return np.unique(start[fits])


def window_keys(h: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Two 64-bit hashes of each window."""
    return np.stack([run_hashes(h, at, window, 41), run_hashes(h, at, window, 42)], axis=1)


# ---------------------------------------------------------------- distributed
def _name(block: int) -> str:
    return f"block-{block:016x}"


def write_blocks(docs: DataFrame, folder: str, size: int = BLOCK) -> DataFrame:
    """Block files of docs (doc_id, text), in ascending doc_id (null last, equal ones by text); their numbers, written."""

    def write(parts):
        forget()
        held, total = [], 0

        def flush():
            nonlocal held, total
            table = pa.Table.from_batches(held)
            table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))
            held, total, block = [], 0, uuid.uuid4().int >> 65
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            put_file(folder, _name(block), sink.getvalue().to_pybytes())
            trim()
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64())], ["block"])

        for b in parts:
            _, offsets = utf8(b.column(1))
            for i, j in runs(offsets, size):
                held.append(b.slice(i, j - i))
                total += int(offsets[j] - offsets[i])
                if total >= size:
                    yield flush()
        if held:
            yield flush()

    return written(docs.mapInArrow(write, "block long"), "block-numbers")


def read_block(folder: str, block: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Text bytes, starts and doc_ids of a block."""
    table = pa.ipc.open_stream(get_file(folder, _name(block))).read_all()
    return *utf8(table.column("text")), table.column("doc_id").combine_chunks()


def block_anchors(blocks: DataFrame, folder: str, window: int) -> DataFrame:
    """anchor, block, twice: the distinct anchors of each block, and whether the block has it more than once."""

    def find(parts):
        forget()
        for b in parts:
            for block in b.column(0).to_pylist():
                h, first = words_of(*read_block(folder, block)[:2])
                a = run_hashes(h, cover_places(first, window), window - period_for(window) + 1, 43)
                a, n = np.unique(a, return_counts=True)
                for i in range(0, len(a), 1 << 14):
                    part = slice(i, i + (1 << 14))
                    yield pa.RecordBatch.from_arrays([pa.array(a[part].view(np.int64)), pa.array(np.full(len(a[part]), block)), pa.array(n[part] > 1)], ["anchor", "block", "twice"])
                del h, a, n
                trim()

    return blocks.mapInArrow(find, "anchor long, block long, twice boolean")


_ROW = "key0 long, key1 long, doc_id long, block long, at long, spans binary"


def repeated_windows(blocks: DataFrame, folder: str, window: int) -> DataFrame:
    """block, at, spans: the places (`at`, or packed in `spans`) of windows that start earlier as well."""
    times = F.sum(F.when(F.col("twice"), 2).otherwise(1)).over(Window.partitionBy("anchor"))
    shared = block_anchors(blocks, folder, window).withColumn("times", times).where("times > 1").select("block", "anchor")

    def extend(table: pa.Table) -> pa.Table:
        forget()
        block, want = table.column("block")[0].as_py(), np.sort(table.column("anchor").to_numpy().view(np.uint64))
        data, offsets, ids = read_block(folder, block)
        h, first = words_of(data, offsets)
        del data
        p = cover_places(first, window)
        a = run_hashes(h, p, window - period_for(window) + 1, 43)
        p = p[want[np.minimum(np.searchsorted(want, a), len(want) - 1)] == a]
        at = window_places(p, first, window)
        keys = window_keys(h, at, window)
        # blocks are in ascending doc_id, so the first place is the earliest
        order = np.lexsort((at, keys[:, 1], keys[:, 0]))
        new = np.append(True, (keys[order][1:] != keys[order][:-1]).any(1)) if len(order) else np.zeros(0, bool)
        again, kept = np.sort(at[order[~new]]), np.sort(order[new])  # by place, which the shuffle's codec makes less of
        of = np.searchsorted(first, at[kept], "right") - 1
        n = len(kept)
        out = [keys[kept, 0].view(np.int64), keys[kept, 1].view(np.int64), ids.take(pa.array(of)), np.full(n, block), at[kept]]
        rows = [pa.RecordBatch.from_arrays([*map(pa.array, out[:2]), out[2], *map(pa.array, out[3:]), pa.nulls(n, pa.binary())], ["key0", "key1", "doc_id", "block", "at", "spans"])]
        if len(again):
            rows.append(pa.RecordBatch.from_pydict({"key0": [block], "key1": [0], "doc_id": [None], "block": [block], "at": [None], "spans": [pack(again)]}, rows[0].schema))
        trim()
        return pa.Table.from_batches(rows)

    found = shared.groupBy("block").applyInArrow(extend, _ROW)
    # a row of spans passes through; it shares its key with none that counts
    mine = F.struct(F.col("at").isNull().alias("spans"), F.col("doc_id").isNull().alias("last"), "doc_id", "block")
    least = F.min(mine).over(Window.partitionBy("key0", "key1"))
    return found.withColumn("least", least).where(F.col("at").isNull() | (mine != F.col("least"))).select("block", "at", "spans")


def kept_bytes(data: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that aren't gone, joined by one space, of each text: bytes of all, and where each text's start."""
    n = len(data)
    if not n:
        return data, np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = np.flatnonzero(inside & (edge[:-1] | np.append(True, ~inside[:-1])))
    ends = np.flatnonzero(inside & (edge[1:] | np.append(~inside[1:], True))) + 1
    delta = np.zeros(n + 1, np.int8)
    delta[begins[~gone]] += 1
    delta[ends[~gone]] -= 1
    keep = np.cumsum(delta[:-1], dtype=np.int8) > 0
    # a space after each kept word but a text's last: what follows the word there is a splitting character
    stay = np.flatnonzero(~gone)
    of = np.searchsorted(offsets, begins[stay], "right") - 1
    mid = stay[np.append(of[1:] == of[:-1], False)] if len(stay) else stay
    keep[ends[mid]] = True
    out = data.copy()
    out[ends[mid]] = 0x20
    at = np.append(0, np.cumsum(keep, dtype=np.int64))[offsets]
    return out[keep], at


def without_windows(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every row of docs (doc_id long, text): the words that are left, joined
    by one space.

    Words are runs of other bytes than space and \\t to \\r, unchanged; null, empty and blank texts have none, and
    kept_text is empty.  A text shorter than a window loses nothing.  Rows with equal doc_id are texts of their own, in
    an order that is settled once; null doc_ids stay null and stand last.  Other columns are left out.  An empty table
    gives an empty one.  A text is handled whole by one task, with some 40 bytes for each of its words."""
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    folder = shared_path(docs.sparkSession, "passage-blocks")
    blocks = write_blocks(rows, folder, block)
    spread = blocks.repartition(max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "block")
    marks = repeated_windows(spread, folder, window)
    every = blocks.select("block", F.lit(None).cast("long").alias("at"), F.lit(None).cast("binary").alias("spans")).unionByName(marks)

    def finish(table: pa.Table) -> pa.Table:
        forget()
        data, offsets, ids = read_block(folder, table.column("block")[0].as_py())
        starts = [pc.drop_null(table.column("at")).to_numpy(), *(np.frombuffer(x.as_py(), np.int64) for x in pc.drop_null(table.column("spans")))]
        first = np.concatenate([[0], np.cumsum([word_count(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])]).astype(np.int64)
        edge = np.zeros(first[-1] + 1, np.int32)
        for s in starts:
            np.add.at(edge, s, 1)
            np.add.at(edge, s + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        kept, at = kept_bytes(data, offsets, gone)
        lost = np.append(0, np.cumsum(gone, dtype=np.int64))[first]
        buffers = [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(kept)]
        out = pa.Table.from_arrays([ids, pa.array(np.diff(first)), pa.array(np.diff(lost)), pa.LargeStringArray.from_buffers(len(ids), *buffers[1:]).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])
        trim()
        return out

    return every.groupBy("block").applyInArrow(finish, "doc_id long, n_words long, n_removed long, kept_text string")


def word_count(data: np.ndarray) -> int:
    inside = ~IS_SPACE[data]
    return int(inside[:1].sum() + (inside[1:] & ~inside[:-1]).sum())


def op11_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: what is left of every document without windows of 20 words that occurred before."""
    kept = without_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = r"""
with t as (select row_number() over (order by doc_id, text) as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select r, i, array_to_string(w[i:i + 19], ' ') as g from (select r, w, unnest(range(1, len(w) - 18)) as i from t where len(w) >= 20)),
e as (select r, i, row_number() over (partition by g order by r, i) as k from s),
c as (select distinct r, i + j as i from (select r, i, unnest(range(0, 20)) as j from e where k > 1)),
x as (select r, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from t),
k as (select x.r, count(*) filter (c.i is null) as kept, string_agg(word, ' ' order by x.i) filter (c.i is null) as text from x left join c on c.r = x.r and c.i = x.i group by 1)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(kept, 0) as bigint) as n_removed, sha256(coalesce(text, '')) as kept_sha256
from t left join k using (r)
"""

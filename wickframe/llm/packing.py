"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces of documents (at most `capacity` tokens) are dealt to shards of a few thousand: at random, or, where documents
have a position, along it, so that sequences follow a training order.  For each shard, several islands evolve populations of packings: crossover injects whole well-filled bins of one parent into the
other, removes the bins that now hold duplicates, and best-fits the displaced pieces.  Between epochs the islands'
elites migrate to the next island.  A shard that reaches its lower bound stops early.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wickframe.llm.common import crc_ids, only, trim, written
from wickframe.llm.tokens import CACHE, RUN, Encoder, batches, default_path

CAPACITY, SHARD, ISLANDS, POPULATION, GENERATIONS, EPOCHS = 1024, 8192, 3, 6, 8, 2
#: Bits of a position within which documents stay together.
STEP = 10


# ---------------------------------------------------------------- packing of one shard (plain Python and numpy)
def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    return int(max(-(-int(sizes.sum()) // capacity), (sizes * 2 > capacity).sum()))


def best_fit(sizes, order, capacity: int, bin_of: np.ndarray, room: list[int]) -> None:
    """Puts the pieces of order, in turn, where the least room is left; changes bin_of and room."""
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room
    have = 0  # bit r: some bin has room r
    for b, r in enumerate(room):
        bins[r].append(b)
        have |= 1 << r
    for i in order:
        s = sizes[i]
        fits = have >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = bins[r].pop()
            if not bins[r]:
                have &= ~(1 << r)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        r -= s
        room[b] = r
        bin_of[i] = b
        bins[r].append(b)
        have |= 1 << r


def fitness(bin_of: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Bins used, and minus the mean squared fill: smaller is better."""
    fill = np.bincount(bin_of, sizes)
    return len(fill), -float(((fill / capacity) ** 2).mean())


def first_packing(sizes: np.ndarray, capacity: int, rng=None) -> np.ndarray:
    """Best fit by descending size; with rng, by sizes shaken a little."""
    key = sizes if rng is None else sizes * rng.uniform(0.7, 1.3, len(sizes))
    out = np.empty(len(sizes), np.int32)
    best_fit(sizes.tolist(), np.argsort(-key, kind="stable").tolist(), capacity, out, [])
    return out


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng) -> np.ndarray:
    """a with whole bins of b: well-filled ones are likelier to be injected."""
    fill = np.bincount(b, sizes)
    well = np.flatnonzero(fill >= np.median(fill))
    chosen = well[rng.random(len(well)) < rng.uniform(0.1, 0.5)]
    if not len(chosen):
        return a
    injected = np.isin(b, chosen)
    broken = np.zeros(int(a.max()) + 1, bool)
    broken[a[injected]] = True
    displaced = np.flatnonzero(broken[a] & ~injected)
    out = np.where(injected, b + len(broken), a)
    keep = np.ones(len(out), bool)
    keep[displaced] = False
    left, out[keep] = np.unique(out[keep], return_inverse=True)
    room = (capacity - np.bincount(out[keep], sizes[keep], minlength=len(left))).astype(int).tolist()
    order = displaced[np.argsort(-sizes[displaced], kind="stable")]
    out = out.astype(np.int32)
    best_fit(sizes.tolist(), order.tolist(), capacity, out, room)
    return out


def evolve(sizes: np.ndarray, population: list[np.ndarray], capacity: int, rng, size: int = POPULATION, generations: int = GENERATIONS, seeded: bool = False) -> list[np.ndarray]:
    """Some generations; best first.  A single packing when it uses as few bins as the lower bound.  An empty
    population is filled with shaken best-fit packings, and with the unshaken one if seeded."""
    bound = lower_bound(sizes, capacity)
    score = lambda x: fitness(x, sizes, capacity)
    scored = sorted(((score(p), k, p) for k, p in enumerate(population)), key=lambda x: x[:2])
    if not scored and seeded:
        p = first_packing(sizes, capacity)
        scored = [(score(p), 0, p)]
    k = len(scored)
    while len(scored) < size and not (scored and scored[0][0][0] <= bound):
        p = first_packing(sizes, capacity, rng)
        scored.append((score(p), k, p))
        k += 1
    scored.sort(key=lambda x: x[:2])
    for _ in range(generations):
        if scored[0][0][0] <= bound:
            return [scored[0][2]]
        children = []
        for _ in range(max(1, size // 2)):
            i, j = sorted(rng.integers(0, len(scored), 2))  # the better of two draws as receiver
            child = crossover(scored[i][2], scored[(j + 1) % len(scored)][2], sizes, capacity, rng)
            children.append((score(child), k, child))
            k += 1
        scored = sorted(scored + children, key=lambda x: x[:2])[:size]
    return [p for _, _, p in (scored[:1] if scored[0][0][0] <= bound else scored)]


# ---------------------------------------------------------------- distributed
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenized_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 2, position: str | None = None, cache: int = CACHE, run: int = RUN) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, salt: each document's ids and end_id; one of more than `capacity` ids
    is cut so that all pieces but the first are full.  Null text is empty.  If position names a column of docs (long,
    not null), pieces have it as `position`.  A table in the shared folder, so the random-looking salt of a piece is settled once."""
    ordered = position is not None
    path = tokenizer or default_path()

    def cut(parts):
        encoder, end, row = Encoder.of_worker(path, cache), np.array([end_id], np.uint32), 0
        for batch in parts:
            first = 0  # of the run, in the batch
            for doc_ids, texts in batches(batch, run):
                out = [[] for _ in range(6)]
                of = []
                for k, (doc_id, ids) in enumerate(zip(doc_ids, encoder.encode(texts), strict=True)):
                    ids, row = np.concatenate([ids, end]), row + 1
                    at, piece = 0, 0
                    while at < len(ids):
                        n = (len(ids) - at) % capacity or capacity
                        for col, x in zip(out, (doc_id, piece, at, n, crc_ids(ids[at : at + n]), row), strict=True):
                            col.append(x)
                        of.append(first + k)
                        at, piece = at + n, piece + 1
                first += len(doc_ids)
                trim()
                cols = [pa.array(x, t) for x, t in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(cols + ([batch.column(2).take(pa.array(of, pa.int64()))] if ordered else []), names)

    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "salt"] + ["position"] * ordered
    rows = only(docs, "doc_id", "text", *[position] * ordered).withColumn("doc_id", F.col("doc_id").cast("long"))
    pieces = rows.mapInArrow(cut, PIECES + ", salt long" + ", position long" * ordered)
    return written(pieces.withColumn("salt", F.xxhash64("doc_id", "piece", "salt")), "pieces")


def along(pieces: DataFrame, shard: int = SHARD) -> DataFrame:
    """Adds shard to pieces with a position: about `shard` of them each, ascending with the position.  Counted by steps
    of 1024 positions, whose documents stay together; the running sum over steps is one task's work."""
    step = F.shiftright("position", STEP)
    counts = pieces.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("step", F.floor(before / shard).alias("shard"))
    return pieces.withColumn("step", step).join(counts, "step").drop("step")


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS) -> DataFrame:
    """Adds sequence_id and offset to pieces (length from 1 to capacity, salt any long): the pieces of a sequence lie
    one after the other from 0 and take at most `capacity` tokens.  Rows that are equal are packed each.  Every shard
    is a packing problem of its own, of about `shard` pieces at any size of the table.  If pieces have a position,
    shards are runs of it, and the sequences of a shard are numbered by the first position in each."""
    ordered = "position" in pieces.columns
    if ordered:
        items = along(pieces, shard)
    else:
        items = pieces.withColumn("shard", F.pmod(F.col("salt"), F.lit(max(1, -(-pieces.count() // shard)))))
    # longest first: full pieces lead and need no packing
    sizes = items.groupBy("shard").agg(F.sort_array(F.collect_list(F.col("length").cast("int")), asc=False).alias("sizes"))
    state_type = "shard long, island int, sizes array<int>, packings array<binary>, n_bins int, fill double"

    def run(epoch):
        def one(parts):
            for batch in parts:
                out = []
                for r in batch.to_pylist():
                    every = np.array(r["sizes"], np.int64)
                    rest = every[every < capacity]
                    rng = np.random.default_rng([r["shard"], r["island"], epoch])
                    given = [np.frombuffer(p, np.int32) for p in r["packings"]]
                    best = evolve(rest, given, capacity, rng, generations=generations, seeded=r["island"] == 0) if len(rest) else [np.zeros(0, np.int32)]
                    bins, fill = fitness(best[0], rest, capacity) if len(rest) else (0, 0.0)
                    out.append(r | {"packings": [p.tobytes() for p in best], "n_bins": bins, "fill": fill})
                yield pa.RecordBatch.from_pylist(out, schema)

        return one

    n_tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("sizes", pa.list_(pa.int32())), ("packings", pa.list_(pa.binary())), ("n_bins", pa.int32()), ("fill", pa.float64())])
    state = sizes.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "sizes", F.expr("cast(array() as array<binary>)").alias("packings"), F.lit(0).alias("n_bins"), F.lit(0.0).alias("fill"))
    for epoch in range(epochs):
        if epoch:  # the elite of an island also joins the next one
            guest = state.select("shard", ((F.col("island") + 1) % islands).alias("island"), "sizes", F.slice("packings", 1, 1).alias("packings"))
            state = state.select("shard", "island", "sizes", "packings").unionByName(guest)
            state = state.groupBy("shard", "island").agg(F.first("sizes").alias("sizes"), F.flatten(F.collect_list("packings")).alias("packings"), F.lit(0).alias("n_bins"), F.lit(0.0).alias("fill"))
        # few rows but much work each: as many tasks as the session asks for, not as few as the bytes would fill
        state = state.repartition(n_tasks, "shard", "island")
        state = written(state.mapInArrow(run(epoch), state_type), "islands")
    best = state.groupBy("shard").agg(F.min_by(F.element_at("packings", 1), F.struct("n_bins", "fill", "island")).alias("packing"))

    def place(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.drop_columns(["salt", "shard"]).append_column("sequence_id", pa.array([], pa.int64())).append_column("offset", pa.array([], pa.int64()))
        left = left.sort_by([("length", "descending"), ("salt", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        length = left.column("length").to_numpy()
        full = int((length == capacity).sum())
        packed = np.frombuffer(right.column("packing")[0].as_py(), np.int32)
        bins = np.concatenate([np.arange(full), full + packed]).astype(np.int64)
        if ordered:
            begin = np.full(int(bins.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(begin, bins, left.column("position").to_numpy())
            rank = np.empty(len(begin), np.int64)
            rank[np.argsort(begin, kind="stable")] = np.arange(len(begin))
            bins = rank[bins]
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(length[order])
        first = np.searchsorted(bins[order], np.arange(int(bins.max()) + 1))
        begin = (ends - length[order])[first]
        offset = np.empty(len(bins), np.int64)
        offset[order] = ends - length[order] - begin[bins[order]]
        shard_no = left.column("shard")[0].as_py()
        out = left.drop_columns(["salt", "shard"])
        return out.append_column("sequence_id", pa.array((shard_no << 24) + bins)).append_column("offset", pa.array(offset))

    return items.groupBy("shard").cogroup(best.groupBy("shard")).applyInArrow(place, PIECES + ", position long" * ordered + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 2, position: str | None = None, cache: int = CACHE, run: int = RUN) -> DataFrame:
    """All documents as pieces in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and position
    if a column of docs gives one; cache: chunks that a worker's encoder keeps, run: bytes of text that it works on at once (memory against time).  An empty table gives none; null and empty texts are a piece of the end id."""
    return pack(tokenized_pieces(docs, capacity, tokenizer, end_id, position, cache, run), capacity)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: packs all documents into sequences of 1024 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Exact top-k inner products: candidates by descending length, partial sums after a rotation, Cauchy-Schwarz bounds.

The rotation comes from the singular vectors of the candidates, so the first coordinates carry most of every inner
product.  Candidates stand in blocks of similar length, longest first.  A block is skipped for a query if even the
longest vector in it, in the query's direction, could not reach the query's k-th score; of the others, the partial
sum over the leading coordinates plus the product of the residual lengths decides which exact scores are computed.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wickframe.llm.common import get_file, only, put_file, shared_path, written

#: Candidates in a block, queries in a block, leading coordinates of the partial sums, blocks that seed the bounds.
BLOCK, QUERIES, LEAD, SEED = 4096, 1024, 16, 1
#: Relative slack of the bounds, for the rounding of rotated sums.
SLACK = 1e-9


def whole(vectors: DataFrame, id_col: str, vec_col: str, scale: float = 256.0) -> DataFrame:
    """id, v: floor(scale * x) of every component, as double.  Vectors that are null, empty, or hold null or
    non-finite components are left out."""
    rows = only(vectors, id_col, vec_col).toDF("id", "x").where("id is not null and x is not null and size(x) > 0")
    v = F.transform("x", lambda c: F.floor(c.cast("double") * scale).cast("double"))
    good = ~F.exists("x", lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return rows.where(good).select("id", v.alias("v"))


def _rows(batch_col: pa.Array, dims: int) -> np.ndarray:
    """Vectors as a matrix; shorter ones end in zeros."""
    col = batch_col.combine_chunks() if isinstance(batch_col, pa.ChunkedArray) else batch_col
    lengths, flat = np.asarray(col.value_lengths()), np.asarray(col.flatten(), float)
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims))
    at = np.concatenate([[0], np.cumsum(lengths)])
    for i, n in enumerate(lengths):
        out[i, :n] = flat[at[i] : at[i + 1]]
    return out


def rotation(vectors: DataFrame, dims: int) -> np.ndarray:
    """Right singular vectors of all vectors, largest first.  Each task sends one matrix of dims by dims."""

    def gram(parts):
        g = np.zeros((dims, dims))
        for b in parts:
            m = _rows(b.column(0), dims)
            g += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(dims), dims)), pa.array(np.tile(np.arange(dims), dims)), pa.array(g.ravel())], ["i", "j", "g"])

    got = vectors.select("v").mapInArrow(gram, "i long, j long, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).toArrow()
    g = np.zeros((dims, dims))
    g[got.column("i").to_numpy(), got.column("j").to_numpy()] = got.column("g").to_numpy()
    values, basis = np.linalg.eigh(g)
    return basis[:, np.argsort(-values)]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def search_block(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, ids: np.ndarray, c: np.ndarray, basis: np.ndarray, k: int, lead: int = LEAD, stats: dict | None = None):
    """(query place, id, score) of every candidate of this block that may be among a query's k best; floor: a score
    that k candidates of each query are known to reach (-inf if none).  q and c hold whole numbers; scores are exact."""
    norms = np.sqrt((c * c).sum(1))
    order = np.argsort(-norms, kind="stable")
    ids, c, norms = ids[order], c[order], norms[order]
    rq, rc = q @ basis, c @ basis
    lead = min(lead, q.shape[1])
    q_rest, c_rest = np.sqrt((rq[:, lead:] ** 2).sum(1)), np.sqrt((rc[:, lead:] ** 2).sum(1))
    q_norm = np.sqrt((q * q).sum(1))
    exact = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1] < 2**53
    out, scored = [], 0
    for i in range(len(q)):
        slack = SLACK * q_norm[i] * (norms[0] if len(norms) else 0)
        n = int(np.searchsorted(-(norms * q_norm[i] + slack), -floor[i], "right"))  # longer ones only
        if not n:
            continue
        bound = rc[:n, :lead] @ rq[i, :lead] + c_rest[:n] * q_rest[i] + slack
        some = np.flatnonzero((bound >= floor[i]) & (ids[:n] != q_ids[i]))
        scored += len(some)
        if exact:
            s = c[some] @ q[i]
            top = _best(s, ids[some], k)
            out += [(i, int(ids[some[t]]), int(s[t])) for t in top]
        else:  # beyond whole doubles: Python's integers
            qi = [int(x) for x in q[i]]
            s = [sum(int(x) * y for x, y in zip(c[m], qi, strict=True)) for m in some]
            top = sorted(range(len(s)), key=lambda t: (-s[t], ids[some[t]]))[:k]
            out += [(i, int(ids[some[t]]), max(-(1 << 63), min((1 << 63) - 1, s[t]))) for t in top]
    if stats is not None:
        stats["scored"] = stats.get("scored", 0) + scored
    return out


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, block: int = BLOCK, per_query_block: int = QUERIES, lead: int = LEAD) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k candidates of highest inner product, its own id left out,
    ties to the smaller id; all, if fewer.  Both sides: id long, v array<double> of whole numbers (whole()).  Vectors
    of different lengths are compared as if the shorter ended in zeros; scores beyond a long stop at its ends; equal
    ids are rows of their own, as queries too.

    Candidates are range-partitioned by length, longest first, and written as block files to the shared folder, the
    queries likewise.  The longest block gives each query a first k-th score; then every other block of candidates is
    read once, by one task, against those query blocks that could still find something in it.  The driver holds no list
    of blocks and no vector, but the rotation (dims by dims)."""
    spark = candidates.sparkSession
    dims = candidates.agg(F.max(F.size("v"))).first()[0]
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = max(dims, queries.agg(F.max(F.size("v"))).first()[0] or 0)
    basis = rotation(candidates, dims)
    folder = shared_path(spark, "vector-blocks")
    n_tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def packed(size):
        def write(parts):
            for b in parts:
                for at in range(0, b.num_rows, size):
                    piece, name = b.slice(at, size), uuid.uuid4().hex
                    m = _rows(piece.column(1), dims)
                    put_file(folder, name, np.asarray(piece.column(0)).astype("<i8").tobytes() + m.astype("<f8").tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([float(np.sqrt((m * m).sum(1)).max(initial=0))])], ["file", "longest"])

        return write

    def blocks_of(vectors, size):
        norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
        ranged = vectors.withColumn("norm", norm).repartitionByRange(max(1, -(-vectors.count() // size)), F.desc("norm")).sortWithinPartitions(F.desc("norm"))
        return written(ranged.select("id", "v").mapInArrow(packed(size), "file string, longest double"), "block-list")

    def load(name):
        raw = get_file(folder, name)
        n = len(raw) // (8 + 8 * dims)
        return np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<f8", n * dims, 8 * n).reshape(n, dims)

    blocks, q_blocks = blocks_of(candidates, block), blocks_of(queries, per_query_block)
    seeds = [r["file"] for r in blocks.orderBy(F.desc("longest"), "file").limit(SEED).collect()]

    seed_type = "q_file string, q_at int, query_id long, vec_id long, score long"

    def rows(name, found, q_ids):
        of = [i for i, _, _ in found]
        cols = [pa.array([name] * len(of), pa.string()), pa.array(of, pa.int32()), pa.array([int(q_ids[i]) for i in of], pa.int64())]
        cols += [pa.array([x for _, x, _ in found], pa.int64()), pa.array([x for _, _, x in found], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["q_file", "q_at", "query_id", "vec_id", "score"])

    def seed(parts):
        for b in parts:
            for name in b.column("file").to_pylist():
                q_ids, q = load(name)
                for c_name in seeds:
                    found = search_block(q_ids, q, np.full(len(q), -np.inf), *load(c_name), basis, k, lead)
                    yield rows(name, found, q_ids)

    seeded = written(q_blocks.repartition(n_tasks, "file").mapInArrow(seed, seed_type), "seed-scores")
    kth = seeded.groupBy("q_file", "q_at").agg(F.element_at(F.sort_array(F.collect_list("score"), asc=False), k).alias("floor"))
    floor = F.coalesce(F.col("floor").cast("double"), F.lit(float("-inf")))
    per_block = kth.groupBy("q_file").agg(F.collect_list("q_at").alias("at"), F.collect_list(floor).alias("floors"))

    def floors(parts):
        for b in parts:
            for r in b.to_pylist():
                name = uuid.uuid4().hex
                put_file(folder, name, np.array(r["at"], "<i8").tobytes() + np.array(r["floors"], "<f8").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([r["q_file"]]), pa.array([name]), pa.array([min(r["floors"])])], ["q_file", "floor_file", "least"])

    known = written(per_block.mapInArrow(floors, "q_file string, floor_file string, least double"), "floor-list")

    def listed(parts):
        sink, name = pa.BufferOutputStream(), uuid.uuid4().hex
        with pa.ipc.new_stream(sink, list_schema) as out:
            for b in parts:
                out.write_batch(pa.RecordBatch.from_arrays(b.columns, schema=list_schema))
        put_file(folder, name, sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    # the list of query blocks is a file as well: one row for each block, read by every task
    list_schema = pa.schema([("file", pa.string()), ("longest", pa.float64()), ("floor_file", pa.string()), ("least", pa.float64())])
    todo = q_blocks.join(known.withColumnRenamed("q_file", "file"), "file", "left").select("file", "longest", "floor_file", "least")
    todo = written(todo.repartition(1).mapInArrow(listed, "name string"), "query-list").first()["name"]

    def search(parts):
        queries = pa.ipc.open_stream(get_file(folder, todo)).read_all().to_pylist()
        for b in parts:
            for c_name, longest in zip(b.column("file").to_pylist(), b.column("longest").to_pylist(), strict=True):
                ids, c = load(c_name)
                for r in queries:
                    least = -np.inf if r["least"] is None else r["least"]
                    if longest * r["longest"] * (1 + SLACK) < least:
                        continue
                    q_ids, q = load(r["file"])
                    floor = np.full(len(q), -np.inf)
                    if r["floor_file"]:
                        raw = get_file(folder, r["floor_file"])
                        floor[np.frombuffer(raw[: len(raw) // 2], "<i8")] = np.frombuffer(raw[len(raw) // 2 :], "<f8")
                    yield rows(r["file"], search_block(q_ids, q, floor, ids, c, basis, k, lead), q_ids)

    rest = blocks.where(~F.col("file").isin(seeds))
    later = rest.repartition(n_tasks, "file").mapInArrow(search, seed_type)
    best = Window.partitionBy("q_file", "q_at").orderBy(F.desc("score"), "vec_id")
    every = seeded.unionByName(later)
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the 5 highest inner products of every 50th vector with all others."""
    vectors = whole(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return top_k(vectors.where(F.col("id") % 50 == 0), vectors, 5)


OP7_SQL = """
with v as (
  select vec_id, [cast(floor(cast(x as double) * 256) as bigint) for x in embedding] as e from embeddings
  where embedding is not null and len(embedding) > 0 and vec_id is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
p as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum([q.e[i] * c.e[i] for i in range(1, len(q.e) + 1)]) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5
"""

"""Pairwise correlation of the candidates' returns."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickframe.operators import indicators as ind
from wickframe.sources.shared import cut


def returns(bars: DataFrame, n: int = 42) -> DataFrame:
    """symbol, pos (1 to n), ret: the last n returns of series that have n + 1 closes, all but the last positive."""
    newest = Window.partitionBy(*ind.SERIES)
    before = ind.back("close", 1)
    d = bars.withColumn("prev", before).withColumn("pos", F.col("bar_idx") - F.max("bar_idx").over(newest) + n).where("pos >= 1 and prev is not null")
    d = d.withColumn("ok", (F.count(F.lit(1)).over(newest) == n) & F.bool_and(F.col("prev") > 0).over(newest)).where("ok")
    return d.select("symbol", "pos", F.try_divide(F.col("close") - F.col("prev"), F.col("prev")).alias("ret"))


def pairs(series: DataFrame, value: str = "ret", key: str = "symbol") -> DataFrame:
    """a < b, r of all pairs of the (few) candidates' series, joined on position: what the funnel left, at most some
    dozens of keys.  r is null without variance or with fewer than two common positions."""
    a = series.select(F.col(key).alias("a"), "pos", F.col(value).alias("x"))
    b = series.select(F.col(key).alias("b"), "pos", F.col(value).alias("y"))
    both = a.join(b, "pos").where("a < b")
    s = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    c = both.join(s, ["a", "b"]).withColumn("dx", F.col("x") - F.col("mx")).withColumn("dy", F.col("y") - F.col("my"))
    g = c.groupBy("a", "b").agg(F.max("n").alias("n"), F.sum(F.col("dx") * F.col("dy")).alias("xy"), F.sum(F.col("dx") * F.col("dx")).alias("xx"), F.sum(F.col("dy") * F.col("dy")).alias("yy"))
    den = F.sqrt(F.col("xx") * F.col("yy"))
    return g.select("a", "b", F.when((F.col("n") >= 2) & (den > 0), F.try_divide(F.col("xy"), den)).alias("r"))


def peers(correlated: DataFrame, least: float = 0.7) -> DataFrame:
    """symbol, peer, r both ways, for r of at least `least`."""
    strong = correlated.where(F.col("r") >= least)
    return strong.select(F.col("a").alias("symbol"), F.col("b").alias("peer"), "r").unionByName(strong.select(F.col("b").alias("symbol"), F.col("a").alias("peer"), "r"))


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Vectors (symbol, v, and what comes with them) as ids, a matrix of what differs from each one's mean, where
    components are, and all columns but v; by id, and without vectors that have a non-finite component."""
    if not t.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros((0, 0), bool), {}
    col = t.column("v").combine_chunks()
    lengths, flat = col.value_lengths().to_numpy(zero_copy_only=False), col.flatten()
    there = np.arange(lengths.max()) < lengths[:, None]
    m = np.zeros(there.shape)
    m[there] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    ok = np.isfinite(m).all(1)
    there[there] = flat.is_valid().to_numpy(zero_copy_only=False)
    ids = t.column("symbol").to_numpy()
    at = np.flatnonzero(ok)[np.argsort(ids[ok], kind="stable")]
    m, there = m[at], there[at]
    mean = m.sum(1, keepdims=True) / np.maximum(there.sum(1, keepdims=True), 1)
    return ids[at], np.where(there, m - mean, 0), there, {c: t.column(c).to_numpy()[at] for c in t.column_names if c != "v"}


def _moments(x, tx, y, ty):
    """r where both rows lack components, from sums over the common positions."""
    d = min(x.shape[1], y.shape[1])
    x, y, tx, ty = x[:, :d] * tx[:, :d], y[:, :d], tx[:, :d].astype(float), ty[:, :d].astype(float)
    k = np.maximum(tx @ ty.T, 1)
    sx, sy = x @ ty.T, tx @ y.T
    xx, yy = (x * x) @ ty.T, tx @ (y * y).T
    vx, vy = xx - sx * sx / k, yy - sy * sy / k
    vx, vy = np.where(vx > 1e-13 * xx, vx, 0), np.where(vy > 1e-13 * yy, vy, 0)
    return np.where(tx @ ty.T >= 2, x @ y.T - sx * sy / k, np.nan) / np.sqrt(vx * vy)


def _hits(first, second, least: float):
    """Of two sets of vectors, places (slices of both, indices in them) and r of at least `least`, a few thousand
    vectors at a time."""
    (a, x, tx, _), (c, y, ty, _) = first, second
    unit = lambda m: m / np.sqrt((m * m).sum(1, keepdims=True))
    with np.errstate(all="ignore"):
        plain = len(a) and len(c) and x.shape[1] == y.shape[1] >= 2 and tx.all() and ty.all()
        x, y = (unit(x), unit(y)) if plain else (x, y)
        for at in range(0, len(a), 512):
            for to in range(0, len(c), 2048):
                p, q = slice(at, at + 512), slice(to, to + 2048)
                r = x[p] @ y[q].T if plain else _moments(x[p], tx[p], y[q], ty[q])
                i, j = np.nonzero(r >= least)
                other = a[p][i] != c[q][j]
                yield p, q, i[other], j[other], r[i, j][other]


PEERS, LINKS = "symbol long, peer long, r double", "symbol long, links long, total double, strongest double"
LINKED = "symbol long, class_id long, links long, mean_r double, strongest double, peer long, r double"
#: Rows that a tile gives out at a time.
OUT = 1 << 16


def _of_tile(least: float, make):
    """A function of a tile (its two blocks, and its vectors with `second` for those of the other block)."""

    def met(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        one, other = key[0].as_py() == key[1].as_py(), t.column("second")
        t = t.drop_columns(["a", "b", "second"])
        first = _matrix(t.filter(pc.invert(other)))
        second = first if one else _matrix(t.filter(other))
        yield from make(first, second, one, _hits(first, second, least))

    return met


def _as_pairs(first, second, one: bool, hits) -> Iterator[pa.RecordBatch]:
    """Pairs both ways, with what came with the vector on the left.  A block meets itself both ways as it is."""
    for p, q, i, j, r in hits:
        i, j = p.start + i, q.start + j
        for x, left, y, right in ((first, i, second, j), (second, j, first, i))[: 1 if one else 2]:
            for k in (slice(at, at + OUT) for at in range(0, len(r), OUT)):
                yield pa.RecordBatch.from_pydict({c: v[left[k]] for c, v in x[3].items()} | {"peer": y[0][right[k]], "r": r[k]})


def _as_links(first, second, one: bool, hits) -> Iterator[pa.RecordBatch]:
    """For each vector its number of links, the sum of their r and the largest."""
    sides = [(x[0], np.zeros(len(x[0]), np.int64), np.zeros(len(x[0])), np.full(len(x[0]), -np.inf)) for x in (first, second)]
    for p, q, i, j, r in hits:
        for (_, links, total, best), at, k in zip(sides[: 1 if one else 2], (p, q), (i, j), strict=False):
            n = len(links[at])
            links[at] += np.bincount(k, minlength=n)
            total[at] += np.bincount(k, r, n)
            np.maximum.at(best[at], k, r)
    out = [[x[s[1] > 0] for x in s] for s in sides]
    yield pa.RecordBatch.from_pydict({name: np.concatenate(x) for name, x in zip(("symbol", "links", "total", "strongest"), zip(*out, strict=True), strict=True)})


def _whole(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("symbol").cast("long").alias("symbol"), F.col("v").cast("array<double>").alias("v")).where("symbol is not null and size(v) > 0")


#: Blocks that vectors are dealt to, at any number of them: a vector is sent once for each, so what is sent grows with
#: the vectors alone.  Only blocks of more than BLOCK_BYTES are divided further.
BLOCKS, BLOCK_BYTES = 16, 64 << 20


def _met(dealt: DataFrame, pairs_of: DataFrame, tasks: int, least: float, make, schema: str) -> DataFrame:
    """Vectors (symbol, v, block, and what else is to come with them), sent to the tiles (block, block2) that theirs is
    part of: each tile is one group.  What tiles give out is in parts, so they hold no more than their vectors."""
    ends = pairs_of.select("block", F.col("block").alias("a"), F.col("block2").alias("b"), F.lit(False).alias("second"))
    ends = ends.unionByName(pairs_of.where("block != block2").select(F.col("block2").alias("block"), F.col("block").alias("a"), F.col("block2").alias("b"), F.lit(True).alias("second")))
    sent = dealt.join(ends, "block").select("a", "b", "second", *[c for c in dealt.columns if c != "block"])
    return sent.repartition(tasks, "a", "b").groupBy("a", "b").applyInArrow(_of_tile(least, make), schema)


def _of_all(vectors: DataFrame, block: int) -> tuple[DataFrame, DataFrame, int]:
    """Vectors dealt to blocks by hash of their symbol, all pairs of blocks, and their number."""
    rows = _whole(vectors)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    n = max(1, min(BLOCKS, -(-size["n"] // block)), -(-size["n"] * (size["dims"] or 0) * 8 // BLOCK_BYTES))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("symbol"), F.lit(n).cast("long")))
    every = F.col("id").alias("block")
    pairs_of = vectors.sparkSession.range(n).select(every, F.explode(F.sequence("id", F.lit(n - 1).cast("long"))).alias("block2"))
    return dealt, F.broadcast(pairs_of) if n <= 256 else pairs_of, n * (n + 1) // 2


def vector_peers(vectors: DataFrame, least: float = 0.7, block: int = 256) -> DataFrame:
    """symbol, peer, r both ways, for r of at least `least`, of all pairs of (symbol long, v array<double>).  r is over
    the positions that both have (a null component counts as missing); there is none without variance, with fewer than
    two common positions or with non-finite components, nor between rows of one symbol.

    Symbols are dealt by hash to at most BLOCKS blocks of at least some `block`, and each pair of blocks is one matrix
    product.  Compared are all pairs, and the output grows with the square of the rows as they do; strong_peers()
    compares fewer where `least` is high."""
    return _met(*_of_all(vectors, block), least, _as_pairs, PEERS)


def vector_links(vectors: DataFrame, least: float = 0.7, block: int = 256) -> DataFrame:
    """The pairs of vector_peers(), and the vectors without any once (peer and r null): symbol, class_id (the smallest
    symbol of those with equal vectors), links (the symbol's number of peers, copies too), mean_r and strongest (of
    their r), peer, r."""
    return _with_links(vectors, *_of_all(vectors, block), least)


def _with_links(vectors: DataFrame, dealt: DataFrame, pairs_of: DataFrame, tasks: int, least: float) -> DataFrame:
    """Tiles meet twice: to count each vector's links, which then come with the vector, and to give out the pairs.  So
    the pairs, which grow with the square of the vectors, are written where they are found and never sent."""
    own = cut(_linked(vectors, _met(dealt, pairs_of, tasks, least, _as_links, LINKS)))
    pairs = _met(dealt.join(own, "symbol"), pairs_of, tasks, least, _as_pairs, LINKED)
    return pairs.unionByName(own.where("links = 0"), allowMissingColumns=True)


def _linked(vectors: DataFrame, found: DataFrame) -> DataFrame:
    """Sums over tiles, and each vector's class."""
    own = vectors.select(F.col("symbol").cast("long").alias("symbol"), F.col("v").cast("array<double>").alias("v")).where("symbol is not null")
    own = own.select("symbol", F.min("symbol").over(Window.partitionBy("v")).alias("class_id"), F.lit(0).cast("long").alias("links"))
    both = own.unionByName(found, allowMissingColumns=True).groupBy("symbol")
    got = both.agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links"), F.sum("total").alias("total"), F.max("strongest").alias("strongest"))
    return got.select("symbol", "class_id", "links", F.try_divide("total", F.col("links").cast("double")).alias("mean_r"), "strongest")


# ---------------------------------------------------------------- only neighbours
#: Leading directions whose coordinates make the grid.
LEAD = 4


def directions(vectors: DataFrame, dims: int, lead: int) -> np.ndarray:
    """The directions in which centred unit vectors (v) vary most: dims by lead.  Each task sends one matrix of dims by
    dims."""

    def gram(batches):
        g = np.zeros((dims, dims))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            g += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(dims), dims)), pa.array(np.tile(np.arange(dims), dims)), pa.array(g.ravel())], ["i", "j", "g"])

    got = vectors.select("v").mapInArrow(gram, "i long, j long, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).toArrow()
    g = np.zeros((dims, dims))
    g[got.column("i").to_numpy(), got.column("j").to_numpy()] = got.column("g").to_numpy()
    values, basis = np.linalg.eigh(g)
    return basis[:, np.argsort(-values)][:, :lead]


def cells(vectors: DataFrame, dims: int, least: float, lead: int = LEAD) -> DataFrame:
    """symbol, v, cell: the place of each vector (whole, of `dims` components) in a grid over its leading coordinates
    once it is centred and of unit length.  Then r = 1 - d * d / 2 of their distance d, so vectors of r >= least lie
    at most sqrt(2 - 2 * least) apart, in every coordinate too: with cells of that width they are in the same or in
    adjacent ones.  Vectors without variance have no cell, nor any r."""
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / dims
    centred = vectors.withColumn("_m", mean).withColumn("_c", F.transform("v", lambda x: x - F.col("_m")))
    centred = centred.withColumn("_l", F.sqrt(F.aggregate("_c", F.lit(0.0), lambda a, x: a + x * x))).where("_l > 0")
    unit = centred.select("symbol", F.col("v").alias("raw"), F.transform("_c", lambda x: x / F.col("_l")).alias("v"))
    basis = directions(unit, dims, lead)
    width = float(np.sqrt(max(2 - 2 * least, 0.0))) * (1 + 1e-9) + 1e-9  # some slack for rounding
    at = [F.floor(F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in basis[:, k]]), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x) / width) for k in range(basis.shape[1])]
    return unit.select("symbol", F.col("raw").alias("v"), F.array(*at).alias("cell"))


def strong_peers(vectors: DataFrame, least: float = 0.9, block: int = 1024, lead: int = LEAD) -> DataFrame:
    """vector_peers(), but vectors are only compared with those in the same or in adjacent cells of a grid: exact, and
    far from all pairs where `least` is high.  A cell with more than `block` vectors, and more than a BLOCKS-th of all,
    is dealt to several blocks.  Vectors with missing components or another number of them than most have no place in
    the grid, and are compared with all."""
    return _met(*_grid(vectors, least, block, lead), _tasks(vectors), least, _as_pairs, PEERS)


def strong_links(vectors: DataFrame, least: float = 0.9, block: int = 256, lead: int = LEAD) -> DataFrame:
    """vector_links(), of the pairs that strong_peers() compares."""
    return _with_links(vectors, *_grid(vectors, least, block, lead), _tasks(vectors), least)


def _tasks(vectors: DataFrame) -> int:
    return max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _grid(vectors: DataFrame, least: float, block: int, lead: int) -> tuple[DataFrame, DataFrame]:
    """Vectors with their blocks (block, symbol, v), and the pairs of blocks (block, block2) that must be compared."""
    rows = cut(_whole(vectors))
    sizes = rows.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("k")).agg(F.max_by("dims", F.struct("k", -F.col("dims"))).alias("dims"), F.sum("k").alias("n"), F.max("dims").alias("most")).first()
    if sizes["n"] is None:
        return rows.withColumn("block", F.lit(0).cast("long")), vectors.sparkSession.createDataFrame([], "block long, block2 long")
    dims = sizes["dims"]
    block = max(1, min(max(block, -(-sizes["n"] // BLOCKS)), BLOCK_BYTES // (8 * sizes["most"])))
    whole = (F.size("v") == dims) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    lead = min(lead, dims)
    placed = cells(rows.where(whole), dims, least, lead)
    loose = rows.where(~whole).select("symbol", "v", F.lit(None).cast("array<long>").alias("cell"))
    placed = cut(placed.unionByName(loose))
    # cells by their number of vectors, and with that of blocks
    many = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("of"))
    parts = many.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).select("cell", "of", "part")
    parts = cut(parts.withColumn("block", F.monotonically_increasing_id()))
    key = lambda d: d.withColumn("cell_", F.to_json(F.struct("cell")))
    dealt = key(placed).join(key(many).select("cell_", "of"), "cell_").withColumn("part", F.pmod(F.xxhash64("symbol"), F.col("of")))
    dealt = dealt.join(key(parts).select("cell_", "part", "block"), ["cell_", "part"])
    dealt = dealt.select("block", "symbol", "v")
    grid = parts.where("cell is not null").select("block", "cell")
    offsets = F.array(*[F.array(*[F.lit(x) for x in o]) for o in itertools.product((-1, 0, 1), repeat=lead)])
    near = grid.withColumn("o", F.explode(offsets)).select("block", F.zip_with("cell", "o", lambda a, b: a + b).alias("cell"))
    pairs_of = near.join(grid.withColumnRenamed("block", "block2"), "cell").where("block <= block2").select("block", "block2")
    # blocks without a place, with each block; among themselves once
    alone = F.broadcast(parts.where("cell is null").select("block", F.lit(0).alias("k")))
    every = parts.select(F.col("block").alias("block2"), F.col("cell").isNull().alias("loose"), F.lit(0).alias("k"))
    against = alone.join(every, "k").where("not loose or block <= block2").select("block", "block2")
    return dealt, cut(pairs_of.unionByName(against))


def compared_share(vectors: DataFrame, least: float, block: int = 1024, lead: int = LEAD) -> float:
    """Of all pairs of vectors, the share that strong_peers() compares."""
    dealt, pairs_of = _grid(vectors, least, block, lead)
    n = dealt.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    both = pairs_of.join(n, "block").join(n.select(F.col("block").alias("block2"), F.col("n").alias("n2")), "block2")
    done = both.agg(F.sum(F.when(F.col("block") == F.col("block2"), F.col("n") * (F.col("n") - 1) / 2).otherwise(F.col("n") * F.col("n2")))).first()[0]
    total = n.agg(F.sum("n")).first()[0]
    return done / (total * (total - 1) / 2)

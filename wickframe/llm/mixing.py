"""Mixing sources to target weights along a curriculum.

Each source has a weight that changes with training progress (straight lines between knots).  Its integral, scaled
to the source's target, is the source's cumulative token demand.  A source's documents stand in a fixed pseudo-random
order, pass after pass; where a document's middle token lies in that stream, the inverted demand gives its training
position.  Range-sorting all documents by position gives the mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wickframe.llm.common import only, written

#: Weights of the sources in code-point order (null last), repeating, and their course: weight at start, middle and
#: end of training, relative to each other.
WEIGHTS, SHAPES, KNOTS = (3, 1, 2), ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5)), (0.0, 0.5, 1.0)
SHARE, PASSES = 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a table that may be broadcast; how far, in training progress, rounding may move a position.
BROADCAST_ROWS, EDGE = 1_000_000, 1e-9


def cumulative(weights, knots=KNOTS) -> list[float]:
    """The integral of the weights up to each knot."""
    out = [0.0]
    for a, b, t, u in zip(weights[:-1], weights[1:], knots[:-1], knots[1:], strict=True):
        out.append(out[-1] + (a + b) / 2 * (u - t))
    return out


def _case(by: Column, values: list) -> Column:
    """The value (a number or list of numbers) at place `by` of values."""
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v]) if isinstance(v, (list, tuple)) else F.lit(v)
    return F.element_at(F.array(*[lit(v) for v in values]), by + 1)


def position(demand: Column, weights: Column, integral: Column, knots=KNOTS) -> Column:
    """Training progress at which the integral of the weights reaches `demand` (a share of the whole, 0 to 1)."""
    y = demand * F.element_at(integral, -1)
    seg = F.least(F.greatest(F.size(F.filter(integral, lambda c: c <= y)), F.lit(1)), F.lit(len(knots) - 1))
    t = F.array(*[F.lit(x) for x in knots])
    a, b = F.element_at(weights, seg), F.element_at(weights, seg + 1)
    t0, width = F.element_at(t, seg), F.element_at(t, seg + 1) - F.element_at(t, seg)
    rest, slope = y - F.element_at(integral, seg), (b - a) / width
    root = F.sqrt(F.greatest(a * a + slope * rest * 2.0, F.lit(0.0)))
    return t0 + F.when(a + root > 0, rest * 2.0 / (a + root)).otherwise(0.0)


def _sized(docs: DataFrame, *more: str) -> DataFrame:
    """Adds to the named columns the size, the sort key (MD5 of the doc_id) and the source's own key."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select(*more, size.alias("size"), key.alias("key"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("of"))


def _bucket(n_buckets: int) -> Column:
    return F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * n_buckets / float(1 << 32)).cast("int")


def _schedule(sums: DataFrame, weights, shapes, knots, share: float, passes: int) -> DataFrame:
    """of, bucket, bucket_start, bucket_size, n, source_size, target, course, integral of every hash bucket of a source.
    sums: of, bucket, source, size, n."""
    before = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("bucket_start", F.coalesce(F.sum("size").over(before), F.lit(0)))

    # One row for each source from here on.
    sources = sums.groupBy("of").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"))
    sources = sources.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = _case(F.col("nth") % len(weights), [float(w) for w in weights])
    sources = sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(passes))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "nth")
    need = F.sum("source_size").over(Window.partitionBy()) * float(share)
    capped = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (need - capped) / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    sources = sources.withColumn("level", level)
    final = F.max(F.when(F.col("most") / F.col("weight") >= F.col("level"), F.col("level"))).over(Window.partitionBy())
    sources = sources.withColumn("target", F.least("most", F.col("weight") * F.coalesce(final, F.lit(float("inf")))))
    shape = F.col("nth") % len(shapes)
    sources = sources.select(
        "of", "source_size", "target", _case(shape, [list(map(float, s)) for s in shapes]).alias("course"),
        _case(shape, [cumulative(s, knots) for s in shapes]).alias("integral"))
    return sums.select("of", "bucket", "bucket_start", F.col("size").alias("bucket_size"), "n").join(sources, "of")


def _place(words: Column, knots) -> Column:
    """Training position at so many words of a source's stream."""
    demand = F.when(F.col("target") > 0, F.least(words / F.col("target"), F.lit(1.0))).otherwise(0.0)
    return position(demand, F.col("course"), F.col("integral"), knots)


def mixed(docs: DataFrame, weights=WEIGHTS, shapes=SHAPES, knots=KNOTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """doc_id, size, source_size, target, repeats, taken, positions (one for each pass that takes the document).

    Size is the number of words (null text: 0).  Targets share `share` of all sizes by weight; one stops at `passes`
    times its source's size and what is left is shared by the others.  A pass takes a document if its middle lies
    within the target, so no source is off by more than half a document.  The order in a source is by the MD5 of the
    doc_id, so reruns agree; rows with equal doc_id and size are told apart by nothing and count each.  An empty table
    gives an empty one.

    One pass over the texts; then only (doc_id, source, size) moves.  Running sums go by source and hash bucket: about
    as many buckets as a bucket has documents, so neither level grows faster than the square root of the table, and a
    source with a third of all rows is dealt over all tasks.
    """
    slim = written(_sized(only(docs, "doc_id", "source", "text"), "doc_id", "source"), "mix-sizes")
    slim = slim.withColumn("bucket", _bucket(2 * math.isqrt(max(1, slim.count())) + 1))
    sums = slim.groupBy("of", "bucket").agg(F.max("source").alias("source"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    stats = _schedule(sums, weights, shapes, knots, share, passes).drop("bucket_size", "n")
    inside = Window.partitionBy("of", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = slim.join(stats, ["of", "bucket"]).withColumn("start", F.col("bucket_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    middle = lambda p: p * F.col("source_size") + F.col("start") + F.col("size") / 2.0
    taken = F.filter(F.sequence(F.lit(0), F.lit(passes - 1)), lambda p: middle(p) <= F.col("target"))
    out = out.withColumn("passes", taken)
    places = F.transform("passes", lambda p: _place(middle(p), knots))
    repeats = F.size("passes")
    return out.select("doc_id", "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"), places.alias("positions"))


def training_order(mix: DataFrame) -> DataFrame:
    """A row for each time a document is taken, range-sorted by training position: doc_id, position, pass."""
    return mix.select("doc_id", F.posexplode("positions").alias("pass", "position")).select("doc_id", "position", "pass").orderBy("position", "doc_id", "pass")


def _ranges(stats: DataFrame, n_ranges: int, knots, passes: int) -> DataFrame:
    """of, bucket, bucket_start, source_size, target, course, integral, goes: for each pass that may take documents of
    the bucket, the ranges of the training order that they can fall in (pass, range, first position, end).  The ranges
    hold about equally many words.  A table of hash buckets: its running sum is one task's work."""
    one = F.sequence(F.lit(0), F.lit(passes - 1))
    begin = lambda p: p * F.col("source_size") + F.col("bucket_start")
    entries = stats.withColumn("pass", F.explode(one)).where(begin(F.col("pass")) <= F.col("target"))
    # a bucket of one document is a point; others stretch a little beyond their documents' middles
    low = F.when(F.col("n") == 1, begin(F.col("pass")) + F.col("bucket_size") / 2.0).otherwise(begin(F.col("pass")))
    high = F.when(F.col("n") == 1, low).otherwise(low + F.col("bucket_size"))
    entries = entries.withColumn("low", _place(low, knots) - EDGE).withColumn("high", _place(high, knots) + EDGE)
    ends = F.array(F.struct(F.col("low").alias("at"), F.lit(0).alias("end")), F.struct(F.col("high").alias("at"), F.lit(1).alias("end")))
    events = entries.select("of", "bucket", "pass", "bucket_size", F.explode(ends).alias("e"))
    events = events.select("of", "bucket", "pass", "e.at", "e.end", F.when(F.col("e.end") == 0, F.col("bucket_size")).otherwise(0).alias("words"))
    order = Window.orderBy("at", "end", "of", "bucket", "pass")
    upto = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.greatest(F.sum("words").over(Window.partitionBy()), F.lit(1))
    nth = F.least(F.floor(upto * float(n_ranges) / total), F.lit(n_ranges - 1)).cast("int")
    events = written(events.withColumn("range", nth), "mix-ranges")
    cuts = events.groupBy("range").agg(F.min("at").alias("first"))
    first = F.when(F.row_number().over(Window.orderBy("range")) > 1, F.col("first")).otherwise(F.lit(float("-inf")))
    cuts = cuts.select("range", first.alias("first"), F.coalesce(F.lead("first").over(Window.orderBy("range")), F.lit(float("inf"))).alias("until"))
    reach = events.groupBy("of", "bucket", "pass").agg(F.min("range").alias("a"), F.max("range").alias("b"))
    goes = reach.withColumn("range", F.explode(F.sequence("a", "b"))).join(cuts, "range")
    goes = goes.groupBy("of", "bucket").agg(F.collect_list(F.struct("pass", "range", "first", "until")).alias("goes"))
    return stats.drop("bucket_size", "n").join(goes, ["of", "bucket"])


def mixed_documents(docs: DataFrame, weights=WEIGHTS, shapes=SHAPES, knots=KNOTS, share: float = SHARE, passes: int = PASSES, broadcast_rows: int = BROADCAST_ROWS, n_ranges: int | None = None) -> DataFrame:
    """The documents that the mix takes, in training order, with the columns of docs; one taken twice comes twice.
    The takes are those of mixed().  Rows that are equal but for their text count each, in order of the text.

    A text is moved once for each time it is taken: its hash bucket's place in the training order is known before the
    documents' own, so the row goes straight to its range of the order.  There its bucket is whole, running sums give
    the exact position, and the range is sorted.  A bucket that reaches over the end of a range goes to both, and each
    keeps the positions that are its own.  The table of buckets is broadcast; if it has more than `broadcast_rows` rows,
    texts are joined with it by shuffle and range-sorted afterwards, which moves them twice."""
    spark, names = docs.sparkSession, [c.lower() for c in docs.columns]
    fresh = docs.toDF(*[f"x{i}" for i in range(len(names))])
    named = {c: F.col(f"x{names.index(c)}").alias(c) for c in ("doc_id", "source", "text")}
    rows = fresh.select(*fresh.columns, *named.values())
    totals = rows.select(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n = n_ranges or max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), totals["n"] // 2000), (totals["bytes"] or 0) >> 27)
    n_buckets = max(2 * math.isqrt(max(1, totals["n"])) + 1, 16 * n)
    sums = _sized(rows, "source").withColumn("bucket", _bucket(n_buckets)).groupBy("of", "bucket")
    sums = sums.agg(F.max("source").alias("source"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    stats = written(_schedule(sums, weights, shapes, knots, share, passes), "mix-buckets")
    rows = _sized(rows, *fresh.columns, "doc_id", "text").withColumn("bucket", _bucket(n_buckets))
    start = lambda w: F.col("bucket_start") + F.coalesce(F.sum("size").over(w), F.lit(0))
    middle = lambda p: p * F.col("source_size") + F.col("start") + F.col("size") / 2.0
    order = ("key", "doc_id", "size", "text")
    ahead = lambda *by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if stats.count() <= broadcast_rows:
        plan = written(_ranges(stats, n, knots, passes), "mix-plan")
        went = rows.join(F.broadcast(plan), ["of", "bucket"]).withColumn("go", F.explode("goes")).drop("goes").withColumn("range", F.col("go.range"))
        went = went.repartitionById(n, F.col("range")).withColumn("pass", F.col("go.pass"))
        went = went.withColumn("start", start(ahead("range", "of", "bucket", "pass"))).withColumn("middle", middle(F.col("pass")))
        went = went.where("middle <= target").withColumn("position", _place(F.col("middle"), knots))
        went = went.where((F.col("position") >= F.col("go.first")) & (F.col("position") < F.col("go.until")))
    else:
        went = rows.join(stats.drop("bucket_size", "n").hint("shuffle_merge"), ["of", "bucket"]).withColumn("start", start(ahead("of", "bucket")))
        went = went.withColumn("pass", F.explode(F.filter(F.sequence(F.lit(0), F.lit(passes - 1)), lambda p: middle(p) <= F.col("target"))))
        went = went.withColumn("position", _place(middle(F.col("pass")), knots)).repartitionByRange(n, "position", "doc_id")
    return went.sortWithinPartitions("position", "doc_id", "pass").select(*fresh.columns).toDF(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: mixes all documents; rows are range-sorted by first training position (those not taken first)."""
    out = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.round(F.get("positions", F.lit(0)), 6).alias("position")).orderBy("position", "doc_id")


OP1_SQL = r"""
with d as (
  select doc_id, source, coalesce('=' || source, '') as grp, md5(coalesce(cast(doc_id as varchar), '')) as k,
    cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents),
s as (
  select grp, cast(sum(size) as bigint) as source_size, row_number() over (order by max(source) nulls last) - 1 as nth
  from d group by grp),
w as (select *, ([3.0::double, 1.0::double, 2.0::double])[1 + nth % 3] as weight, 2.0::double * source_size as most from s),
l as (
  select *, (sum(source_size) over () * 1.5::double
    - coalesce(sum(most) over (order by most / weight, nth rows between unbounded preceding and 1 preceding), 0::double))
    / sum(weight) over (order by most / weight, nth rows between current row and unbounded following) as lev from w),
t as (
  select *, least(most, weight * coalesce(max(case when most / weight >= lev then lev end) over (), 'inf'::double)) as target
  from l),
r as (
  select doc_id, size, source_size, target, nth % 3 as shape,
    coalesce(sum(size) over (partition by d.grp order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0)
    + size / 2.0::double as mid from d join t using (grp)),
p as (
  select *, case when target > 0 then mid / target else 0 end as dem,
    (case when mid <= target then 1 else 0 end) + (case when mid + source_size <= target then 1 else 0 end) as n from r),
q as (
  select *, case when dem < (case shape when 0 then 0.625::double when 1 then 0.5::double else 0.375::double end) then 0 else 1 end as seg,
    case shape when 0 then -1.0::double when 1 then 0.0::double else 1.0::double end as slope from p),
v as (
  select *, dem - seg * (case shape when 0 then 0.625::double when 1 then 0.5::double else 0.375::double end) as rest,
    case when seg = 1 then 1.0::double when shape = 0 then 1.5::double when shape = 1 then 1.0::double else 0.5::double end as a from q)
select doc_id, size, source_size, target, cast(n * size as bigint) as taken,
  case when n > 0 then round(seg * 0.5::double + rest * 2 / (a + sqrt(greatest(a * a + slope * rest * 2, 0))), 6) end as position
from v
"""

"""Order MinHash fingerprints, by DataFrame functions only.

A text's units are its words, longer ones cut into runs of eight characters.  Its k-mers of units (k = 3, with two blanks
before the first unit and after the last) are numbered by occurrence, and each pair of k-mer and number is hashed.  The
hashes are dealt to 32 bins; of each bin the two smallest are selected, brought back into text order, and hashed
together.  Two texts agree in a bin only if they have the same minimal k-mers there in the same order, so likeness falls
with edits that move text as well as with those that change it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wickframe.llm.common import only, written

K, BINS, TUPLE = 3, 32, 2
UNIT = r"[^\x20\x09-\x0D]{1,8}"
_POS = (1 << 24) - 1  # a k-mer's place, in the low 24 bits
_HASH = (1 << 33) - 1


def _low(x: Column, mask: int) -> Column:
    return x.bitwiseAND(F.lit(mask))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds out: array<long>, ascending: for each bin that isn't empty, the bin's number times 2**32 and 32 bits of
    its hash.  Text must not be null; one without words has an empty fingerprint.  Each step is a projection of its
    own: the ones it reads are read twice, so Catalyst doesn't fold them into it, and each is computed once a row."""
    keep = df.columns
    units = F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda w: F.xxhash64(w))
    df = df.select(*keep, units.alias("_u"))
    blanks = F.array(*[F.lit(0).cast("long")] * (K - 1))
    df = df.select(*keep, F.concat(blanks, "_u", blanks).alias("_h"), F.size("_u").alias("_n"))
    h, n = F.col("_h"), F.col("_n")
    # places take 24 bits: in texts of over 16 million k-mers some neighbours share one
    coarse = F.greatest(F.ceil(F.log2(n + K)).cast("int") - 24, F.lit(0))
    places = F.when(n > 0, F.sequence(F.lit(0), n + K - 2)).otherwise(F.expr("cast(array() as array<int>)"))
    kmer = lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(K)])
    kmers = F.transform(places, lambda i: kmer(i).bitwiseAND(F.lit(~_POS)).bitwiseOR(F.call_function("shiftright", i, coarse).cast("long")))
    df = df.select(*keep, F.sort_array(kmers).alias("_p"))
    p = F.col("_p")
    same = lambda x, y: F.shiftright(x, 24) == F.shiftright(y, 24)
    first = lambda a: F.filter(a, lambda x, j: (j == 0) | ~same(x, F.get(a, j - 1)))
    rest = F.filter(p, lambda x, j: (j > 0) & same(x, F.get(p, j - 1)))
    df = df.select(*keep, first(p).alias("_first"), rest.alias("_rest"))
    r = F.col("_rest")
    starts = F.filter(F.transform(r, lambda x, j: F.when((j == 0) | ~same(x, F.get(r, j - 1)), j)), lambda j: j.isNotNull())
    df = df.select(*keep, "_first", "_rest", F.when(F.size(r) > 0, starts).otherwise(F.expr("cast(array() as array<int>)")).alias("_starts"))
    s = F.col("_starts")
    numbered = lambda x, o: F.struct(x.alias("x"), o.alias("o"))
    code = lambda x, o: _code(F.xxhash64(F.shiftright(x, 24), o), x)
    repeats = F.flatten(F.transform(s, lambda a, j: F.transform(F.slice(r, a + 1, F.coalesce(F.get(s, j + 1), F.size(r)) - a), lambda x, o: code(x, o + 1))))
    ones = F.transform("_first", lambda x: code(x, F.lit(0)))
    df = df.select(*keep, F.sort_array(F.concat(ones, F.when(F.size(s) > 0, repeats).otherwise(F.expr("cast(array() as array<bigint>)")))).alias("_q"))
    q = F.col("_q")
    bin_of = lambda x: F.shiftright(x, 57)
    least = F.filter(q, lambda x, j: (j < TUPLE) | (bin_of(F.get(q, j - TUPLE)) != bin_of(x)))
    df = df.select(*keep, least.alias("_m"))
    m = F.col("_m")

    def tuple_hash(x, j):
        y = F.get(m, j + 1)
        g, g2 = F.shiftright(x, 24), F.shiftright(y, 24)
        paired = y.isNotNull() & (bin_of(y) == bin_of(x))
        both = F.when(_low(x, _POS) < _low(y, _POS), F.xxhash64(g, g2)).otherwise(F.xxhash64(g2, g))
        hashed = F.when(paired, both).otherwise(F.xxhash64(g))
        leads = (j == 0) | (bin_of(F.get(m, j - 1)) != bin_of(x))
        return F.when(leads, F.shiftleft(bin_of(x), 32) + _low(hashed, (1 << 32) - 1))

    df = df.select(*keep, "_m", F.transform(m, tuple_hash).alias("_t"))
    return df.select(*keep, F.filter("_t", lambda x: x.isNotNull()).alias(out))


def _code(g: Column, x: Column) -> Column:
    """Bin (5 bits), 33 bits of hash, place (24 bits), in a positive long."""
    return F.shiftleft(_low(g, BINS - 1), 57) + F.shiftleft(_low(F.shiftright(g, 5), _HASH), 24) + _low(x, _POS)


def as_text(print_: Column) -> Column:
    """The fingerprint as text: for each bin, ten hexadecimal digits."""
    return F.array_join(F.transform(print_, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of bins, of those filled in either, that agree; 1 for two empty fingerprints."""
    bins = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, 32)), F.transform(b, lambda x: F.shiftright(x, 32))))
    return F.when(bins == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(bins, F.lit(1)).cast("double"))


def _order(key: str, text: str) -> Column:
    """Rows stand in ascending key, null last; rows of equal key by a hash of their text."""
    return F.struct(F.col(key).isNull().alias("last"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("key"), F.xxhash64(text).alias("t"))


def with_next(df: DataFrame, key: str, text: str, n_parts: int | None = None) -> DataFrame:
    """The rows of df, dealt to ranges of their order (see _order); a range's first row also goes, as a guest, to the
    range before (that of the first range to the last), so no task sees more than its range.  Adds _order, _part, _guest
    and _turn, for following().  The ranges begin at rows that are there: ranges of the order's columns alone tell
    where.  Each row finds its range in two steps, by every s-th range and by those in between."""
    n = n_parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = df.select(_order(key, text).alias("o")).select("o.*")
    ranged = slim.repartitionByRange(n, "last", "key", "t").select(F.spark_partition_id().alias("p"), F.struct("last", "key", "t").alias("o"))
    heads = written(ranged.groupBy("p").agg(F.min("o").alias("o")), "range-heads")
    heads = heads.agg(F.array_sort(F.collect_list("o")).alias("heads"))
    step = max(1, round(n**0.5))
    every = F.filter("heads", lambda h, i: i % step == 0)
    table = heads.select(F.struct("heads", every.alias("every"), F.size("heads").alias("n")).alias("ranges"))
    cols = df.columns
    df = df.select(*cols, _order(key, text).alias("_order"), table.scalar().alias("_ranges"))
    upto = lambda a: F.size(F.filter(a, lambda h: h <= F.col("_order"))) - 1
    df = df.select(*cols, "_order", "_ranges", upto(F.col("_ranges.every")).alias("_coarse"))
    block = F.slice("_ranges.heads", F.col("_coarse") * step + 1, step)
    df = df.select(*cols, "_order", "_ranges", (F.col("_coarse") * step + upto(block)).alias("_part"))
    head = F.get("_ranges.heads", F.col("_part")) == F.col("_order")
    before = F.when(F.col("_part") == 0, F.col("_ranges.n")).otherwise(F.col("_part")) - 1
    own = lambda p, g, turn: F.struct(p.alias("part"), g.alias("guest"), turn.alias("turn"))
    here = own(F.col("_part"), F.lit(False), F.lit(0))
    # a guest of the last range comes after all its rows
    there = own(before, F.lit(True), F.when(F.col("_part") == 0, 1).otherwise(0))
    df = df.select(*cols, "_order", F.explode(F.when(head, F.array(here, there)).otherwise(F.array(here))).alias("_to"))
    df = df.select(*cols, "_order", F.col("_to.part").alias("_part"), F.col("_to.guest").alias("_guest"), F.col("_to.turn").alias("_turn"))
    return df.repartitionById(n, F.col("_part"))


def following(df: DataFrame, text: str) -> DataFrame:
    """The rows of with_next with `next`, a struct of the columns of the following row (after the last row, the first),
    without the guests."""
    cols = [c for c in df.columns if c not in ("_order", "_part", "_guest", "_turn")]
    order = Window.partitionBy("_part").orderBy("_turn", "_order", "_guest", text)
    return df.withColumn("next", F.lead(F.struct(*cols)).over(order)).where(~F.col("_guest")).select(*cols, "next")


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: fingerprints of all documents, of their edited texts, and how alike these and the next documents are.
    A table of one row is followed by itself; an empty table gives an empty one; rows of equal doc_id follow each other
    by a hash of their text, those without one come last."""
    docs = only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    rows = following(with_next(with_fingerprint(docs, "text", "print"), "doc_id", "text"), "text")
    n, quarter = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - int(floor(length(text) / 4)))"), F.substring(F.col("next.text"), F.lit(1), quarter))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "print", F.col("next.print").alias("next_print"), edited.alias("edited"))
    rows = with_fingerprint(rows, "edited", "edited_print")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"), likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"))

"""N-gram Jaccard join by vertical partitioning.

The global order of all n-grams (64-bit hashes of five words) is cut into fragments.

1. Every text's set is cut along the fragments.  A fragment's task sees all n-grams of its range, so it knows in how
   many sets each occurs; n-grams of one set alone say nothing about links and stay behind.  A set of which less than
   80 % is shared has no partner and goes no further.
2. Sets that are left are ordered by frequency, rarest first.  Two sets of similarity 0.8 share an n-gram among the
   rarest 20 % of either, so only sets that meet in such a prefix are candidates, if their sizes allow it.
3. The order by frequency (equal ones by hash) is cut into ranges.  Each set is cut along them; for candidate pairs
   every range counts its overlap separately, and the counts are summed per pair.
4. Candidates are drawn as stars (each set with a few leaders of its groups), so a group of thousands of near copies
   costs thousands of pairs; links join sets into components; after some rounds with other leaders, all pairs that
   still meet in a prefix from different components are counted.  So no link between components is missed, and links inside one, which
   change no component, needn't all be counted.

Texts with equal sets are one class from the start and are never paired.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wickframe.llm.common import dealt, discard, forget, mix, odd, only, pack, runs, shared_base, trim, utf8, word_hashes, written

WORDS, SIMILARITY = 5, 80
#: Bytes of text whose n-grams make up about one fragment; bytes and texts of a batch.
FRAGMENT, BATCH, BATCH_ROWS = 6 << 20, 8 << 20, 60_000
#: Ranges of the frequency order in which the overlaps of candidate pairs are counted.
PARTS = 4
#: Rounds of stars before all pairs that are left are counted; leaders of a set in the first round.
STARS, LEADERS = 5, 8



def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of so many words; fewer words are one run."""
    h, _, first = word_hashes(data, offsets)
    with np.errstate(over="ignore"):
        if len(h) >= words:
            m = odd(11, words)
            run = sum(h[k : len(h) - words + 1 + k] * m[k] for k in range(words))
            run = mix(run)
        else:
            run = np.zeros(0, np.uint64)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= words:
                out.append(np.unique(run[a : b - words + 1]))
            elif b > a:
                short = mix((h[a:b] * odd(12, words)[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a))
                out.append(np.array([short], np.uint64))
            else:
                out.append(h[:0])
    return out


def need(n, percent: int):
    """Smallest overlap of a set of n with any linked to it."""
    return -(-np.asarray(n) * percent // 100)


def signature(s: np.ndarray) -> bytes:
    """16 bytes that tell a set from others."""
    with np.errstate(over="ignore"):
        return np.array([s.sum(dtype=np.uint64), mix(s ^ np.uint64(0x6A09E667F3BCC909)).sum(dtype=np.uint64)], np.uint64).tobytes()


_CUT = pa.schema([("key", pa.int64()), ("kind", pa.int8()), ("batch", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_CUT_SQL = "key long, kind byte, batch long, a binary, b binary, c binary"
_ROW = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("n", "<i8"), ("s0", "<u8"), ("s1", "<u8"), ("t", "<i8")])


def planes(h: np.ndarray) -> bytes:
    """Ascending hashes byte by byte: their leading bytes hardly change, and the shuffle's codec makes little of them."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _cut(docs: DataFrame, n_fragments: int, words: int) -> DataFrame:
    """Batches of texts, cut along the fragments.  Kind 0, by fragment: hashes, and the text of the batch each is of.
    A hash of several texts of a batch goes only once (text 65535); kind 1, by batch: those texts.  Kind 2, by
    batch: doc_id, size and signature of every text, and a hash of its characters.  docs: doc_id, text, that hash."""
    salt = uuid.uuid4().int & ((1 << 20) - 1)

    def cut(parts):
        from pyspark import TaskContext

        forget()
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush():
            nonlocal held, size, seq
            batch = (part << 24 | seq) << 20 | salt
            seq += 1
            rows = np.zeros(len(held), _ROW)
            seen: dict[bytes, int] = {}
            sets, of = [], []
            for k, (doc_id, t, s) in enumerate(held):
                sig = signature(s)
                rows[k] = (doc_id or 0, doc_id is None, len(s), *np.frombuffer(sig, np.uint64), t)
                if len(s) and sig not in seen:
                    seen[sig] = k
                    sets.append(s)
                    of.append(k)
            held, size, s = [], 0, None
            out = [(batch, 2, batch, rows.tobytes(), b"", b"")]
            if sets:
                d = np.repeat(np.array(of, np.uint16), [len(s) for s in sets])
                h = np.concatenate(sets)
                sets.clear()
                order = np.argsort(h, kind="stable")
                h, d = h[order], d[order]
                del order
                lead = np.empty(len(h), bool)
                lead[0] = True
                lead[1:] = h[1:] != h[:-1]
                at = np.flatnonzero(lead)
                n = np.diff(np.append(at, len(h)))
                many = np.repeat(n > 1, n)
                if many.any():
                    out.append((batch, 1, batch, pack(h[many]), pack(d[many]), b""))
                h, d, n = h[at], np.where(n > 1, 65535, d[at]).astype(np.uint16), n.astype(np.uint32)
                frag = ((h >> np.uint64(32)) * np.uint64(n_fragments) >> np.uint64(32)).astype(np.int64)
                edges = np.searchsorted(frag, np.arange(n_fragments + 1))
                for f in np.unique(frag).tolist():
                    i, j = edges[f], edges[f + 1]
                    some = d[i:j] == 65535
                    out.append((f, 0, batch, planes(h[i:j]), pack(d[i:j]), pack(n[i:j][some])))
                del h, d, n, many, frag
            trim()
            return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), _CUT, strict=True)], schema=_CUT)

        for b in parts:
            data, offsets = utf8(b.column(1))
            ids, ts = b.column(0).to_pylist(), b.column(2).to_pylist()
            for i, j in runs(offsets):
                at = offsets[i : j + 1]
                held += zip(ids[i:j], ts[i:j], shingles(data[at[0] : at[-1]], at - at[0], words), strict=True)
                size += int(at[-1] - at[0])
                if size >= BATCH or len(held) >= BATCH_ROWS:
                    # a batch's texts are numbered with 16 bits
                    rest = held[BATCH_ROWS:]
                    held = held[:BATCH_ROWS]
                    yield flush()
                    while rest:
                        held, rest = rest[:BATCH_ROWS], rest[BATCH_ROWS:]
                        yield flush()
        if held:
            yield flush()

    return docs.mapInArrow(cut, _CUT_SQL)


def _shared(cuts: DataFrame, n_fragments: int) -> DataFrame:
    """Of each fragment the hashes of two sets or more, with their number, back to the batches (kind 0: hashes, texts,
    numbers); kinds 1 and 2 pass through."""

    def count(parts):
        forget()
        hs, ds, ns, bs, batches = [], [], [], [], []
        for b in parts:
            through = b.filter(pa.compute.not_equal(b.column("kind"), 0))
            if through.num_rows:
                yield through
            for r in b.filter(pa.compute.equal(b.column("kind"), 0)).to_pylist():
                h, d = unplanes(r["a"]), np.frombuffer(r["b"], np.uint16)
                n = np.ones(len(h), np.uint32)
                n[d == 65535] = np.frombuffer(r["c"], np.uint32)
                hs.append(h)
                ds.append(d)
                ns.append(n)
                bs.append(len(h))
                batches.append(r["batch"])
        if not hs:
            return
        h = np.concatenate(hs)
        hs.clear()
        d, n = np.concatenate(ds), np.concatenate(ns)
        ds.clear(), ns.clear()
        of = np.repeat(np.arange(len(batches), dtype=np.int32), bs)
        order = np.argsort(h, kind="stable")
        h = h[order]
        lead = np.empty(len(h), bool)
        lead[0] = True
        lead[1:] = h[1:] != h[:-1]
        at = np.flatnonzero(lead)
        total = np.add.reduceat(n[order].astype(np.int64), at)
        run = np.cumsum(lead) - 1
        some = total[run] > 1
        h, d, of, total = h[some], d[order][some], of[order][some], np.minimum(total[run[some]], 2**32 - 1).astype(np.uint32)
        del n, run, some, lead, order
        order = np.argsort(of, kind="stable")
        h, d, of, total = h[order], d[order], of[order], total[order]
        trim()
        edges = np.searchsorted(of, np.arange(len(batches) + 1))
        for k in np.unique(of).tolist():
            i, j = edges[k], edges[k + 1]
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((batches[k], 0, batches[k], planes(h[i:j]), pack(d[i:j]), pack(total[i:j])), _CUT, strict=True)], schema=_CUT)

    return dealt(cuts, n_fragments).mapInArrow(count, _CUT_SQL)


_SETS_SQL = "kind byte, doc_id long, n long, sig binary, t long, hashes array<long>, counts array<int>, prefix int"


def _sets(shared: DataFrame, percent: int) -> DataFrame:
    """Kind 2: doc_id, size, signature and hash of every text.  Kind 0: one text of each class of its batch that may
    have links: its shared hashes, rarest first, in how many sets each is, and how many of them are in its prefix."""

    def gather(table: pa.Table) -> pa.Table:
        forget()
        rows, many, single = None, None, []
        trim()
        for r in table.to_pylist():
            if r["kind"] == 2:
                rows = np.frombuffer(r["a"], _ROW)
            elif r["kind"] == 1:
                many = (np.frombuffer(r["a"], np.uint64), np.frombuffer(r["b"], np.uint16))
            else:
                single.append((unplanes(r["a"]), np.frombuffer(r["b"], np.uint16), np.frombuffer(r["c"], np.uint32)))
        sig = np.ascontiguousarray(np.stack([rows["s0"], rows["s1"]], 1)).tobytes()
        sigs = [sig[16 * k : 16 * k + 16] if n else None for k, n in enumerate(rows["n"].tolist())]
        doc_ids = pa.array(rows["doc_id"], mask=rows["null"].astype(bool))
        nothing = [pa.nulls(len(rows), t) for t in (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32())]
        out = [pa.array(np.full(len(rows), 2, np.int8)), doc_ids, pa.array(rows["n"]), pa.array(sigs, pa.binary()), pa.array(rows["t"]), *nothing]
        h, d, n = (np.concatenate([x[k] for x in single]) if single else np.zeros(0, t) for k, t in enumerate((np.uint64, np.uint16, np.uint32)))
        if many is not None:  # their numbers came once for the batch
            lists = d == 65535
            order = np.argsort(h[lists])
            lh, ln = h[lists][order], n[lists][order]
            h, d, n = np.concatenate([h[~lists], many[0]]), np.concatenate([d[~lists], many[1]]), np.concatenate([n[~lists], ln[np.searchsorted(lh, many[0])]])
        have = np.bincount(d, minlength=len(rows))
        least = need(rows["n"], percent)
        alive = (have >= np.maximum(least, 1)) & (rows["n"] > 0)
        some = alive[d]
        h, d, n = h[some], d[some], n[some]
        order = np.lexsort((h, n, d))
        h, d, n = h[order].astype(np.int64), d[order], np.minimum(n[order], 2**31 - 1).astype(np.int32)
        which = np.flatnonzero(alive)
        edges = np.append(np.searchsorted(d, which), len(d))
        prefix = (rows["n"] - least + 1 - (rows["n"] - have))[which]
        edges = pa.array(edges.astype(np.int32))
        lists, counts = pa.ListArray.from_arrays(edges, pa.array(h)), pa.ListArray.from_arrays(edges, pa.array(n))
        least = pa.array(prefix.astype(np.int32))
        some = pa.array(which)
        sets = [pa.array(np.zeros(len(which), np.int8)), *[x.take(some) for x in out[1:5]], lists, counts, least]
        names = ["kind", "doc_id", "n", "sig", "t", "hashes", "counts", "prefix"]
        return pa.Table.from_arrays([pa.chunked_array([a, b]) for a, b in zip(out, sets, strict=True)], names)

    return shared.groupBy("batch").applyInArrow(gather, _SETS_SQL)


def order_ranges(sets: DataFrame, parts: int = PARTS) -> list[int]:
    """The frequencies that cut the order of all n-grams into ranges of about equal size: parts - 1 numbers, ascending.
    Where a frequency has more n-grams than a range holds it is there several times."""
    if parts < 2 or not sets.limit(1).count():
        return [0] * (parts - 1)
    found = sets.select(F.explode("counts").alias("k")).stat.approxQuantile("k", [i / parts for i in range(1, parts)], 0.01)
    return sorted(int(x) for x in found)


def range_of(count: Column, h: Column, cuts: list[int]) -> Column:
    """The range of an n-gram of that frequency and hash.  One whose frequency is cut several times is in the range
    that its hash, read as unsigned, falls in: ranges follow the order by frequency and hash."""
    below = sum((F.when(count > c, 1).otherwise(0) for c in cuts), F.lit(0))
    at = sum((F.when(count == c, 1).otherwise(0) for c in cuts), F.lit(0))
    return (below + F.shiftright(F.shiftrightunsigned(h, 33) * (at + 1), 31)).cast("int")


def cut_sets(sets: DataFrame, cuts: list[int]) -> DataFrame:
    """id, n, f, part: each set's n-grams by range of the global order.  sets: id, n, hashes, counts."""
    of = F.transform("hashes", lambda h, i: range_of(F.get("counts", i), h, cuts))
    cut = sets.select("id", "n", "hashes", of.alias("of"))
    cut = cut.select("id", "n", "hashes", "of", F.explode(F.sequence(F.lit(0), F.lit(len(cuts)))).alias("f"))
    part = F.filter("hashes", lambda h, i: F.get("of", i) == F.col("f"))
    return cut.select("id", "n", "f", part.alias("part")).where(F.size("part") > 0)


def overlaps(pairs: DataFrame, cut: DataFrame) -> DataFrame:
    """a, b, n_a, n_b, overlap of pairs (a, b): every fragment counts what both have there, and the counts are summed."""
    left = cut.select(F.col("id").alias("a"), F.col("n").alias("n_a"), "f", F.col("part").alias("part_a"))
    right = cut.select(F.col("id").alias("b"), F.col("n").alias("n_b"), "f", F.col("part").alias("part_b"))
    met = pairs.select("a", "b").join(left, "a").join(right, ["b", "f"])
    return met.withColumn("partial", F.size(F.array_intersect("part_a", "part_b"))).groupBy("a", "b").agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.sum("partial").alias("overlap"))


def components(links: DataFrame, parts: int | None = None) -> DataFrame:
    """id, root of every node that links (a, b) have: the smallest id it is connected with.  Labels spread to
    neighbours and jump to the label's own label, so the rounds grow with the logarithm of the longest chain."""
    both = written(links.select(F.col("a").alias("id"), F.col("b").alias("to")).union(links.select("b", "a")).distinct(), "links", parts)
    labels = written(both.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("root")), "labels", parts)
    while True:
        near = both.join(labels.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.min("root").alias("near"))
        step = labels.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        # the old root learns of the smaller one, and passes it on to all that have it
        told = step.groupBy("old").agg(F.min("root").alias("better"))
        new = written(step.join(told, "old").select("id", "old", F.least("root", "better").alias("root")), "labels", parts)
        discard(labels)
        if not new.where("root != old").limit(1).count():
            discard(both)
            return new.select("id", "root")
        labels = new.select("id", "root")


def joined(labels: DataFrame | None, found: DataFrame, parts: int | None = None) -> DataFrame:
    """labels (id, root) after more links (a, b): only the roots that these connect are labelled anew.  The table that
    labels come from goes."""
    if labels is None:
        return components(found, parts)
    root = lambda c: labels.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}"))
    ends = found.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    between = written(ends.where("a != b").distinct(), "root-links", parts)
    moved = components(between, parts)
    fresh = moved.select("id", F.col("id").alias("root")).join(labels.select("id"), "id", "left_anti")
    every = labels.unionByName(fresh).join(moved.select(F.col("id").alias("root"), F.col("root").alias("better")), "root", "left")
    out = written(every.select("id", F.coalesce("better", "root").alias("root")), "labels", parts)
    discard(between, moved, labels)
    return out


def members(docs: DataFrame, words: int = WORDS, percent: int = SIMILARITY) -> DataFrame:
    """doc_id, t (a hash of the text), n, sig (of the set), root (of the set's component, if it has links) and
    component_id of every row of docs (doc_id, text)."""
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_fragments = max(1, -(-size // FRAGMENT))
    shared_base(docs.sparkSession)
    # batch numbers and contents must stay as they are whatever is lost, so the last pass over them is written
    gathered = written(_sets(_shared(_cut(rows, n_fragments, words), n_fragments), percent), "sets")
    every = written(gathered.where("kind = 2").select("doc_id", "t", "n", "sig"), "members")
    # one set of each class, by all 128 bits of its signature; classes get numbers of their own, settled once
    sets = gathered.where("kind = 0").groupBy("sig").agg(*[F.first(c).alias(c) for c in ("n", "hashes", "counts", "prefix")])
    sets = written(sets.select(F.monotonically_increasing_id().alias("id"), "sig", "n", "hashes", "counts", "prefix"), "classes")
    discard(gathered)
    labels, names = _linked(sets, percent)
    classes = every.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"))
    if labels is None:
        classes = classes.select("sig", F.lit(None).cast("long").alias("root"), F.col("least").alias("component"))
    else:
        classes = classes.join(names.join(labels, "id").select("sig", "root"), "sig", "left")
        whole = classes.where("root is not null").groupBy("root").agg(F.min("least").alias("component"))
        classes = classes.join(whole, "root", "left").select("sig", "root", F.coalesce("component", "least").alias("component"))
    # a text without words is alone; one with words has its component's least doc_id
    own = F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return every.join(classes, "sig", "left").select("doc_id", "t", "n", "sig", "root", own.alias("component_id"))


def _linked(sets: DataFrame, percent: int) -> tuple[DataFrame | None, DataFrame]:
    """id, root of all classes with links (None if there are none); and id, sig of all classes.  The table of sets
    goes."""
    few = 1 + sets.count() // 50_000  # files of tables with some numbers for each set, or pair
    names = written(sets.select("id", "sig"), "class-names", few)
    cut = written(cut_sets(sets, order_ranges(sets)), "cut-sets", 4 * few)
    # place of a prefix n-gram in its whole set: those of this set alone are the rarest and come first
    at = sets.select("id", "n", F.posexplode(F.expr("slice(hashes, 1, prefix)")).alias("at", "hash"), F.size("hashes").alias("have"))
    first = written(at.select("hash", "id", "n", (F.col("at") + 1 + F.col("n") - F.col("have")).alias("at")), "prefixes", 4 * few)
    discard(sets)
    shared = first.groupBy("hash").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("hash")
    met = written(first.join(shared, "hash", "left_semi"), "prefixes", 4 * few)
    discard(first)

    labels, tested = None, []
    # Sizes that can link; and what can still be shared from the n-gram that two sets meet in, if it is their first.
    # Of two linked sets the first common n-gram passes, so no link is lost.
    fits = F.expr(f"100 * least(n, nx) >= {percent} * greatest(n, nx) and (100 + {percent}) * (1 + least(n - at, nx - ax)) >= {percent} * (n + nx)")
    for step in range(STARS + 1):
        now = met.withColumn("root", F.col("id")) if labels is None else met.join(labels, "id", "left").withColumn("root", F.coalesce("root", "id"))
        mixed = now.groupBy("hash").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("hash")
        now = now.join(mixed, "hash", "left_semi")
        if step < STARS:
            # leaders of a group: some sets of the component that has most of it, others and more of them each round
            most = F.max(F.struct("k", F.xxhash64("root", F.lit(step)).alias("j"), "root"))["root"].alias("lead")
            most = now.groupBy("hash", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("hash").agg(most)
            nth = F.row_number().over(Window.partitionBy("hash").orderBy(F.xxhash64("id", "hash", F.lit(step))))
            lead = now.join(most, "hash").where("root = lead").withColumn("_r", nth).where(F.col("_r") <= 4**step)
            lead = lead.select("hash", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("root").alias("rx"), F.col("at").alias("ax"))
            # each set with those leaders that it meets most often
            pairs = now.join(lead, "hash").where("root != rx").where(fits).groupBy("id", "x").agg(F.count(F.lit(1)).alias("k"))
            nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("k"), F.xxhash64("x", F.lit(step))))
            pairs = pairs.withColumn("_r", nth).where(F.col("_r") <= LEADERS * 2**step).select("id", "x")
        else:
            right = now.select("hash", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("root").alias("rx"), F.col("at").alias("ax"))
            pairs = now.join(right, "hash").where("root < rx").where(fits).select("id", "x")
        pairs = pairs.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct()
        for old in tested:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs", few)
        if not pairs.limit(1).count():
            continue
        linked = F.expr(f"100 * overlap >= {percent} * (n_a + n_b - overlap)")
        found = written(overlaps(pairs, cut).where(linked).select("a", "b"), "found", few)
        tested.append(pairs)
        if found.limit(1).count():
            labels = joined(labels, found, few)
        discard(found)
    discard(cut, met, *tested)
    return labels, names


def similar(docs: DataFrame, words: int = WORDS, percent: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id long, text).

    Words are runs of other bytes than space and \\t to \\r, A-Z taken as a-z; a text with fewer than `words` is one
    n-gram; null, empty and blank texts have none and link with nothing.  Two texts link if 100 * intersection >=
    percent * union; component_id is the smallest doc_id reachable (null doc_ids stay null and stand after all others,
    so a component of such rows alone has none).  Rows with equal doc_id are texts of their own, of one component only
    if they link.  An empty table gives an empty one."""
    return members(docs, words, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = SIMILARITY) -> DataFrame:
    """One row of docs for each component: that of the smallest doc_id (null last; of equal ones, the smallest hash of
    the text; of equal rows, any).  Texts without words are alone and stay."""
    found = members(docs, words, percent).where("sig is not null")
    who = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t")
    group = ("root", F.when(F.col("root").isNull(), F.col("sig")).alias("alone"))
    least = found.select(*group, who.alias("who")).groupBy("root", "alone", "who").agg(F.count(F.lit(1)).alias("times"))
    least = least.groupBy("root", "alone").agg(F.min(F.struct("who", "times")).alias("m"))
    stay = written(least.select(F.col("m.who.doc_id").alias("id_"), F.col("m.who.t").alias("t_"), F.col("m.times").alias("times_")), "stay")
    have = [c.lower() for c in docs.columns]
    fresh = docs.toDF(*[f"x{i}" for i in range(len(have))])
    doc_id, text = F.col(f"x{have.index('doc_id')}").cast("long"), F.col(f"x{have.index('text')}")
    both = doc_id.eqNullSafe(F.col("id_")) & (F.xxhash64(text) == F.col("t_"))
    blank = ~F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = fresh.join(stay, both, "left")
    out = kept.where(blank | (F.col("times_") == 1)).select(*fresh.columns)
    if stay.where("times_ > 1").limit(1).count():
        again = kept.where(~blank & (F.col("times_") > 1)).dropDuplicates(["id_", "t_"])
        out = out.unionByName(again.select(*fresh.columns))
    return out.toDF(*docs.columns)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: components of near copies among all documents, five words, similarity 0.8."""
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
e as (select a, b from l union select b, a from l),
r as (select doc_id as id, doc_id as root from documents union select e.b, r.root from r join e on e.a = r.id and r.root < e.b)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.root as component_id
from documents d left join n using (doc_id) join (select id, min(root) as root from r group by 1) m on m.id = d.doc_id
"""

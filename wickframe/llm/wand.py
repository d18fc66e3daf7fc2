"""Ranked lexical search: Block-Max WAND over posting lists in compressed blocks.

The index has a segment file for each some megabytes of documents.  In a segment every term has a posting list, cut into
blocks of 128: the blocks' first and last document, their greatest impact, and the postings themselves (differences of
documents and occurrences, in as few bytes as the block needs) in a part of the file of its own.

A query walks a segment's documents in order.  Between two ends of blocks its terms' current blocks stay the same, so the
sum of their greatest impacts bounds the scores of all documents there.  Moving along these ends touches no posting
(the shallow moves); where the sum is below the query's threshold, the k-th best score so far, the stretch is skipped,
blocks and all.  Whatever the pivot test on whole lists' maxima would skip is skipped by this one too, as no list's
maximum is below its blocks'.  Only the blocks under the other stretches are decompressed, and their documents scored
exactly.  Blocks of rare terms, whose documents lie far apart, are opened at once: there a stretch is one document.  The stretches of the highest bounds come first, so that the threshold is high from the start, and it is kept
from one segment of a task to the next.

Terms are 64-bit hashes.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wickframe.llm.common import LOWER, forget, get_file, only, put_file, runs, shared_path, trim, utf8, word_hashes, written

TOP = 50
#: Postings in a block; bytes of text in a segment; items in a block of queries; segments that one task searches.
BLOCK, SEGMENT, ITEMS, GROUP = 128, 4 << 20, 256, 16
#: Stretches that seed a threshold, and that are scored at once afterwards.
SEED, BATCH = 64, 256
#: A block whose documents are on average further apart is opened at once.
SPARSE = 4
#: Bytes that are no part of a term: of ASCII all but digits and letters.
OUTSIDE = np.ones(256, bool)
OUTSIDE[0x30:0x3A] = OUTSIDE[0x41:0x5B] = OUTSIDE[0x61:0x7B] = OUTSIDE[0x80:] = False
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of all texts, A-Z as a-z, and how many each text has."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in runs(offsets):
        h, _, at = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], LOWER, OUTSIDE)
        hashes.append(h)
        counts.append(np.diff(at))
    return np.concatenate(hashes), np.concatenate(counts)


def norms(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """m of documents of n terms: 50, and 50 times their length against the mean one's."""
    if int(n.max(initial=0)) * docs * 50 < 1 << 62:
        return 50 + (50 * docs * n) // max(1, total)
    return np.array([50 + 50 * docs * int(x) // total for x in n], np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    total = int(counts.sum())
    return np.repeat(starts - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(total)


# ---------------------------------------------------------------- segments
_SIZES = "<QQQQ"
_META = np.dtype([("first", "<u4"), ("last", "<u4"), ("best", "<u4"), ("n", "u1"), ("wide", "u1")])


def _width(most: np.ndarray) -> np.ndarray:
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))


def _planes(values: np.ndarray, width: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
    """Writes each value, little-endian in so many bytes, at its place."""
    for k in range(4):
        some = width > k
        out[at[some] + k] = (values[some] >> (8 * k)) & 255


def segment(hashes: np.ndarray, counts: np.ndarray, doc_ids: pa.Array, docs: int, total: int, block: int = BLOCK) -> bytes:
    """A segment of documents of so many terms each: the file's bytes.  docs and total: N and L of the whole corpus."""
    doc = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    order = np.lexsort((doc, hashes))
    h, d = hashes[order], doc[order]
    new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    tf, h, d = np.diff(np.append(at, len(h))), h[at], d[at]
    lead = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
    begin = np.flatnonzero(lead)
    df = np.diff(np.append(begin, len(h)))
    place = np.arange(len(h)) - np.repeat(begin, df)
    heads = np.flatnonzero(place % block == 0)  # of blocks
    sizes = np.diff(np.append(heads, len(h)))
    impact = impacts(tf, norms(counts, docs, total)[d])
    step = np.diff(d, prepend=0)
    step[heads] = 0
    meta = np.zeros(len(heads), _META)
    if len(heads):
        meta["first"], meta["last"], meta["n"] = d[heads], d[heads + sizes - 1], sizes - 1
        meta["best"] = np.maximum.reduceat(impact, heads)
        wd, wt = _width(np.maximum.reduceat(step, heads)), _width(np.maximum.reduceat(tf, heads))
        meta["wide"] = wd << 4 | wt
    else:
        wd = wt = np.zeros(0, np.int64)
    start = np.append(0, np.cumsum(sizes * (wd + wt)))
    within = np.arange(len(h)) - np.repeat(heads, sizes)
    data = np.zeros(int(start[-1]), np.uint8)
    wd_, wt_, base = (np.repeat(x, sizes) for x in (wd, wt, start[:-1]))
    _planes(step, wd_, base + within * wd_, data)
    _planes(tf, wt_, base + np.repeat(sizes * wd, sizes) + within * wt_, data)
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    known = np.asarray(doc_ids.is_valid())
    ids = doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
    words, df = h[begin], df.astype("<u4")
    parts = [squeeze(np.concatenate([words.view(np.uint8), df.view(np.uint8)]).tobytes()), squeeze(meta.tobytes()), squeeze(ids.tobytes() + counts.astype("<u4").tobytes() + known.tobytes()), data.tobytes()]
    return struct.pack(_SIZES, *(len(p) for p in parts[:3]), len(words)) + b"".join(parts)


class Segment:
    """Reads a segment; postings are decompressed block by block, once asked for."""

    def __init__(self, raw: bytes, dictionary_only: bool = False):
        import zstandard

        grow = zstandard.ZstdDecompressor().decompress
        a, b, c, n = struct.unpack_from(_SIZES, raw)
        at = struct.calcsize(_SIZES)
        words = grow(raw[at : at + a])
        self.words, self.df = np.frombuffer(words, "<u8", n), np.frombuffer(words, "<u4", n, 8 * n)
        if dictionary_only:
            return
        self.meta = np.frombuffer(grow(raw[at + a : at + a + b]), _META)
        docs = grow(raw[at + a + b : at + a + b + c])
        n_docs = len(docs) // 13
        self.ids, self.counts, self.known = np.frombuffer(docs, "<i8", n_docs), np.frombuffer(docs, "<u4", n_docs, 8 * n_docs).astype(np.int64), np.frombuffer(docs, bool, n_docs, 12 * n_docs)
        self._data = np.frombuffer(raw, np.uint8, offset=at + a + b + c)
        blocks = -(-self.df.astype(np.int64) // BLOCK)
        self.first_block = np.append(0, np.cumsum(blocks))
        wide = self.meta["wide"].astype(np.int64)
        self.sizes, self._wd, self._wt = self.meta["n"].astype(np.int64) + 1, wide >> 4, wide & 15
        self._start = np.append(0, np.cumsum(self.sizes * (self._wd + self._wt)))
        self.read = 0

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Places of terms in the dictionary (-1: not there)."""
        if not len(self.words):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.words, terms), len(self.words) - 1)
        return np.where(self.words[at] == terms, at, -1)

    def _values(self, start: np.ndarray, width: np.ndarray, n: np.ndarray) -> np.ndarray:
        at = ranges(np.zeros(len(n), np.int64), n) * np.repeat(width, n) + np.repeat(start, n)
        w, out = np.repeat(width, n), self._data[at].astype(np.int64)
        for k in range(1, 4):
            some = w > k
            if not some.any():
                break
            out[some] |= self._data[at[some] + k].astype(np.int64) << (8 * k)
        return out

    def postings(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents and occurrences of these blocks, and each block's number of postings."""
        n = self.sizes[blocks]
        self.read += len(blocks)
        if not len(blocks):
            return n, n, n
        step = self._values(self._start[blocks], self._wd[blocks], n)
        tf = self._values(self._start[blocks] + n * self._wd[blocks], self._wt[blocks], n)
        upto = np.cumsum(step)
        head = np.append(0, np.cumsum(n)[:-1])
        doc = upto - np.repeat(upto[head] - self.meta["first"][blocks], n)
        return doc, tf, n


class Best:
    """The k best (score, then smallest doc_id, null last) that a query has found."""

    def __init__(self, k: int):
        self._k = k
        self.scores, self.ids, self.known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def threshold(self) -> int:
        """A score below this cannot get in."""
        return int(self.scores[-1]) if len(self.scores) == self._k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        some = scores >= self.threshold
        if not some.any():
            return
        s, i, v = (np.concatenate([a, b[some]]) for a, b in ((self.scores, scores), (self.ids, ids), (self.known, known)))
        order = np.lexsort((i, ~v, -s))[: self._k]
        self.scores, self.ids, self.known = s[order], i[order], v[order]


def search(seg: Segment, m: np.ndarray, terms: np.ndarray, weights: np.ndarray, best: Best, seed: int = SEED, batch: int = BATCH) -> None:
    """Adds the segment's documents to the query's best.  m: norms of its documents."""
    at = seg.find(terms)
    lists, w = at[at >= 0], weights[at >= 0]
    if not len(lists):
        return
    n_blocks = seg.first_block[lists + 1] - seg.first_block[lists]
    blocks, weight = ranges(seg.first_block[lists], n_blocks), np.repeat(w, n_blocks)
    first, last = seg.meta["first"][blocks].astype(np.int64), seg.meta["last"][blocks].astype(np.int64)
    # a block of few documents far apart bounds nearly nothing: it is opened, and each posting is a place of its own
    wide = last - first >= SPARSE * seg.sizes[blocks]
    doc, tf, n = seg.postings(blocks[wide])
    exact = np.repeat(weight[wide], n) * impacts(tf, m[doc])
    blocks, weight = blocks[~wide], weight[~wide]
    first, last = np.concatenate([first[~wide], doc]), np.concatenate([last[~wide], doc])
    most = np.concatenate([weight * seg.meta["best"][blocks].astype(np.int64), exact])
    # shallow moves: stretches between ends of blocks, and the sum of greatest impacts over each
    edges, place = np.unique(np.concatenate([first, last + 1]), return_inverse=True)
    change = np.zeros(len(edges), np.int64)
    np.add.at(change, place, np.concatenate([most, -most]))
    bound = np.cumsum(change)
    begin, end = place[: len(first)], place[len(first) :]  # stretches that a block lies under
    done = np.zeros(len(edges), bool)

    def score(stretches: np.ndarray) -> None:
        """Scores all documents of these stretches (ascending)."""
        done[stretches] = True
        live = np.zeros(len(edges) + 1, np.int64)
        live[stretches + 1] = 1
        live = np.cumsum(live)
        under = np.flatnonzero(live[end] > live[begin])
        known = under[under >= len(blocks)]
        under = under[under < len(blocks)]
        doc, tf, n = seg.postings(blocks[under])
        inside = np.searchsorted(edges, doc, "right") - 1
        keep = live[inside + 1] > live[inside]
        doc, tf, v = doc[keep], tf[keep], np.repeat(weight[under], n)[keep]
        docs, of = np.unique(np.concatenate([doc, first[known]]), return_inverse=True)
        total = np.zeros(len(docs), np.int64)
        np.add.at(total, of, np.concatenate([v * impacts(tf, m[doc]), most[known]]))
        best.add(total, seg.ids[docs], seg.known[docs])

    top = np.argsort(-bound, kind="stable")[:seed]
    score(np.sort(top[bound[top] >= best.threshold])) if (bound[top] >= best.threshold).any() else None
    at = 0
    while True:
        more = np.flatnonzero((bound[at:] >= best.threshold) & ~done[at:])[:batch]
        if not len(more):
            return
        at += int(more[0])
        score(at + more - more[0])


# ---------------------------------------------------------------- distributed
def corpus_size(rows: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms with repeats."""

    def count(parts):
        docs = total = 0
        for b in parts:
            data, offsets = utf8(b.column(0))
            for i, j in runs(offsets):
                d, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                inside = ~OUTSIDE[d]
                start = inside.copy()
                start[1:] &= ~inside[:-1]
                begins = at[:-1][at[:-1] < len(d)]
                start[begins] = inside[begins]
                n = np.diff(np.append(0, np.cumsum(start))[at])
                docs, total = docs + int((n > 0).sum()), total + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([total])], ["docs", "total"])

    got = rows.select("text").mapInArrow(count, "docs long, total long").agg(F.sum("docs"), F.sum("total")).first()
    return int(got[0] or 0), int(got[1] or 0)


def write_index(rows: DataFrame, folder: str, docs: int, total: int, size: int = SEGMENT) -> DataFrame:
    """Segment files of rows (doc_id, text); a table of their names, with numbers that deal them to groups."""

    def write(parts):
        forget()
        ids, hashes, counts, held = [], [], [], 0

        def flush():
            nonlocal ids, hashes, counts, held
            name = f"segment-{uuid.uuid4().hex}"
            put_file(folder, name, segment(np.concatenate(hashes), np.concatenate(counts), pa.concat_arrays(ids), docs, total))
            ids, hashes, counts, held = [], [], [], 0
            trim()
            return pa.RecordBatch.from_arrays([pa.array([name])], ["file"])

        for b in parts:
            data, offsets = utf8(b.column(1))
            for i, j in runs(offsets, size):
                h, n = terms_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                hashes.append(h)
                counts.append(n)
                ids.append(b.column(0).slice(i, j - i))
                held += int(offsets[j] - offsets[i])
                if held >= size:
                    yield flush()
        if ids:
            yield flush()

    return written(rows.mapInArrow(write, "file string"), "segments")


def query_terms(items: DataFrame) -> DataFrame:
    """item, term: the distinct terms of each item."""

    def find(parts):
        for b in parts:
            h, n = terms_of(*utf8(b.column(1)))
            item, h = np.repeat(np.asarray(b.column(0)), n), h.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(h)], ["item", "term"])

    return items.mapInArrow(find, "item long, term long").distinct()


def frequencies(segments: DataFrame, folder: str, terms: DataFrame) -> DataFrame:
    """term, df of the terms that any document has: looked up in the segments' dictionaries, with the terms as blocks
    of a file each."""

    def pack(table: pa.Table) -> pa.Table:
        name = f"terms-{uuid.uuid4().hex}"
        put_file(folder, name, np.sort(table.column("term").to_numpy().view(np.uint64)).tobytes())
        return pa.table({"part": [table.column("part")[0].as_py()], "terms": [name]})

    n = 1 + terms.count() // 100_000
    blocks = written(terms.select("term").distinct().withColumn("part", F.pmod("term", F.lit(n))).groupBy("part").applyInArrow(pack, "part long, terms string"), "term-blocks", 1)

    def look(parts):
        forget()
        for b in parts:
            for file, name in zip(b.column("file").to_pylist(), b.column("terms").to_pylist(), strict=True):
                seg, want = Segment(get_file(folder, file), dictionary_only=True), np.frombuffer(get_file(folder, name), "<u8")
                at = seg.find(want)
                some = at >= 0
                yield pa.RecordBatch.from_arrays([pa.array(want[some].view(np.int64)), pa.array(seg.df[at[some]].astype(np.int64))], ["term", "df"])
            trim()

    return _dealt(segments, blocks, n).mapInArrow(look, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _dealt(left: DataFrame, blocks: DataFrame, n: int) -> DataFrame:
    """Each row of left with each of the n blocks of queries (part, file), dealt over tasks."""
    tasks = max(1, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))).join(blocks, "part").drop("part")
    return pairs.repartition(tasks, *pairs.columns)


def ranked(documents: DataFrame, items: DataFrame, k: int = TOP, size: int = SEGMENT, group: int = GROUP, per_block: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) of every item (item_id, text), score above 0.

    Terms are runs of digits, letters and all that isn't ASCII, A-Z as a-z; null has none.  Equal scores by ascending
    doc_id, null last; rows with equal doc_id are documents of their own.  Equal items count once; two items of one id
    and different texts are ranked each by itself.  Empty tables and items without known terms give no rows."""
    spark = documents.sparkSession
    rows = only(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    folder = shared_path(spark, "postings")
    docs, total = corpus_size(rows)
    segments = write_index(rows, folder, docs, total, size)
    asked = only(items, "item_id", "text").dropDuplicates().select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    asked = written(asked, "items")  # their numbers stay
    terms = written(query_terms(asked.select("item", "text")), "item-terms")
    df = frequencies(segments, folder, terms)
    weight = F.floor(F.log(F.lit(2.0 * docs + 2) / (2 * F.col("df") + 1)) * 1000).cast("long")
    weighted = terms.join(df.select("term", weight.alias("w")), "term").where("w > 0")
    nth = F.row_number().over(Window.orderBy("item"))  # a row for each item
    numbered = asked.select("item", F.floor((nth - 1) / per_block).alias("part"))

    def pack(table: pa.Table) -> pa.Table:
        name = f"queries-{uuid.uuid4().hex}"
        part = table.column("part")[0].as_py()
        table = table.select(["item", "term", "w"]).sort_by([("item", "ascending"), ("term", "ascending")])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        put_file(folder, name, sink.getvalue().to_pybytes())
        return pa.table({"part": [part], "queries": [name]})

    n = 1 + (asked.count() - 1) // per_block if docs else 1
    queries = written(weighted.join(numbered, "item").groupBy("part").applyInArrow(pack, "part long, queries string"), "query-blocks", 1)

    def find(parts):
        for b in parts:
            for files, name in zip(b.column("files").to_pylist(), b.column("queries").to_pylist(), strict=True):
                forget()
                table = pa.ipc.open_stream(get_file(folder, name)).read_all()
                item, at = np.unique(table.column("item").to_numpy(), return_index=True)
                term, w = table.column("term").to_numpy().view(np.uint64), table.column("w").to_numpy()
                at = np.append(at, len(term))
                best = [Best(k) for _ in item]
                for file in files:
                    seg = Segment(get_file(folder, file))
                    m = norms(seg.counts, docs, total)
                    for q in range(len(item)):
                        search(seg, m, term[at[q] : at[q + 1]], w[at[q] : at[q + 1]], best[q])
                    del seg
                sizes = [len(x.scores) for x in best]
                known = np.concatenate([x.known for x in best])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(item, sizes)), pa.array(np.concatenate([x.ids for x in best]), mask=~known), pa.array(np.concatenate([x.scores for x in best]))], ["item", "doc_id", "score"])
                trim()

    # a group of segments is one row: thresholds are kept from one to the next
    tasks = max(1, -(-segments.count() // group))
    tasks = max(tasks, min(segments.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    groups = segments.groupBy(F.pmod(F.xxhash64("file"), F.lit(tasks)).alias("g")).agg(F.array_sort(F.collect_list("file")).alias("files")).select("files")
    found = _dealt(groups, queries, max(1, n)).mapInArrow(find, "item long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op13_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the 50 best documents of every benchmark item."""
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
with t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
s as (select count(*) as n, sum(len(w)) as l from t where len(w) > 0),
p as (select doc_id, len(w) as n, unnest(w) as term from t),
f as (select doc_id, n, term, count(*) as tf from p group by all),
q as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
d as (select term, count(*) as df from f group by 1),
w as (select term, cast(floor(1000 * ln(cast(2 * s.n + 2 as double) / (2 * df + 1))) as bigint) as w from d, s),
x as (
  select q.item_id, f.doc_id, cast(sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 20 * (100 - 50 + ((50 * f.n * s.n) // cast(s.l as bigint)))))) as bigint) as score
  from q join w using (term) join f using (term), s group by 1, 2),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from x where score > 0)
select item_id, cast(rank as int) as rank, doc_id, score from r where rank <= 50
"""

"""Removal of repeated passages: every byte covered by a string of `length` bytes that starts earlier as well.

Texts go to block files in the shared folder.  A local-minimum rule picks anchors from each text: whatever `length`
bytes one looks at, their anchor depends on these bytes alone, so equal strings have equal anchors at equal places.
Only anchors that occur twice matter; around each, the segment that can hold a string with this anchor (168 bytes
for strings of 100) is looked at, and equal segments are collapsed: in each block, then between all of them.  Only what is left, different contents around the same anchor, is cut out and moved.  In a block equal means equal bytes; between blocks, equal 128-bit BLAKE2b
digests.

The segments of a range of anchors are a collection of documents whose suffix order is built column by column: each
round puts one symbol in front of every document's suffix, and from the symbols in the old order (this column of the
collection's Burrows-Wheeler transform) follow the new order, by one stable pass, and the new common prefixes, by
minima of the old ones.  After each round, neighbours that share `length` symbols or more are equal strings; all of
them but the earliest are marked.  Strings with the same anchor can only be equal at the same column, so columns
needn't be merged with each other.  Between rounds only the order and the common prefixes are kept; the columns are
read one after the other.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickframe.llm.common import dealt, forget, get_file, mix, odd, only, pack, put_file, runs, shared_path, trim, utf8, written

LENGTH, KMER = 100, 32
#: Bytes of text in a block file, and whose anchors make up about one fragment; a fixed share of the input each.
BLOCK, FRAGMENT = 4 << 20, 16 << 20
#: Longest run of text whose anchors are found at once (places take 24 bits).
PIECE = 1 << 18
_PLACE = np.uint64((1 << 24) - 1)
_TABLE, _STEPS = odd(21, 256), odd(22, 8)


def kmer_hashes(data: np.ndarray, k: int = KMER) -> np.ndarray:
    """A 64-bit hash of the k bytes from each place on; k is a power of two."""
    with np.errstate(over="ignore"):
        h, width, step = _TABLE[data], 1, 0
        while width < k:
            h = h[:-width] * _STEPS[step] + h[width:]
            width, step = 2 * width, step + 1
        return mix(h)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = KMER) -> tuple[np.ndarray, np.ndarray]:
    """Places (in data) and hashes of the anchors of all texts, ascending."""
    places, hashes = [], []
    for i, j in runs(offsets, PIECE):
        start, stop = int(offsets[i]), int(offsets[j])
        at = start
        while at < stop:  # a text longer than PIECE goes in overlapping pieces
            end = min(stop, at + (PIECE << 3))
            part = data[at:end]
            if len(part) >= length:
                h = kmer_hashes(part, k)
                v = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
                width = length - k + 1
                low, span = v, 1
                while 2 * span <= width:
                    low = np.minimum(low[:-span], low[span:])
                    span *= 2
                if span < width:
                    low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
                # strings inside one text only
                inside = np.ones(len(low), bool)
                ends = offsets[i + 1 : j + 1] - at
                ends = ends[(ends > 0) & (ends < len(part))]
                if len(ends):
                    cut = np.zeros(len(low) + 1, np.int32)
                    np.add.at(cut, np.clip(ends - length + 1, 0, len(low)), 1)
                    np.add.at(cut, np.clip(ends, 0, len(low)), -1)
                    inside = np.cumsum(cut[:-1]) == 0
                p = (low[inside] & _PLACE).astype(np.int64)
                p = np.unique(p) if len(p) and (np.diff(p) < 0).any() else p[np.append(True, p[1:] != p[:-1])] if len(p) else p
                places.append(p + at)
                hashes.append(mix(h[p]))  # anchors are small hashes; mixed, they are dealt evenly
            if end == stop:
                break
            at = end - length + 1
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p, h = np.concatenate(places), np.concatenate(hashes)
    if (np.diff(p) <= 0).any():
        p, first = np.unique(p, return_index=True)
        h = h[first]
    return p, h


def segments(data: np.ndarray, p: np.ndarray, lo: np.ndarray, hi: np.ndarray, left: int, width: int) -> np.ndarray:
    """A row of `width` bytes for each anchor, from `left` bytes before it on; 255 beyond its text [lo, hi)."""
    at = p[:, None] + np.arange(-left, width - left)
    inside = (at >= lo[:, None]) & (at < hi[:, None])
    return np.where(inside, data[np.clip(at, 0, len(data) - 1)], np.uint8(255))


def repeated(rows: np.ndarray, rank: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """First and last column at which a string of `length` bytes starts that a row of smaller rank has at the same
    column (-1: none).  Row i has text from begin[i] to end[i] only.  Ranks are distinct."""
    m, width = rows.shape
    first, last = np.full(m, -1), np.full(m, -1)
    if m < 2:
        return first, last
    columns = np.ascontiguousarray(rows.T)
    order = np.arange(m, dtype=np.int32)
    # empty suffixes are alike; the cap is enough, as common prefixes beyond it say nothing more
    common = np.full(m, length, np.uint8)
    common[0] = 0
    for j in range(width - 1, -1, -1):
        symbols = columns[j][order]  # of the transform, in the order of the suffixes behind them
        by = np.argsort(symbols, kind="stable")
        sorted_symbols = symbols[by]
        ahead = np.minimum.reduceat(np.append(common, 0), by + 1)[:-1]  # least between a row and the next of its symbol
        new = np.zeros(m, np.uint8)
        alike = sorted_symbols[1:] == sorted_symbols[:-1]
        new[1:][alike] = np.minimum(ahead[alike].astype(np.int16) + 1, length).astype(np.uint8)
        order, common = order[by], new
        if j <= width - length:
            lead = np.flatnonzero(common < length)
            if len(lead) == m:
                continue
            r = rank[order]
            least = np.minimum.reduceat(r, lead)
            later = (r != np.repeat(least, np.diff(np.append(lead, m)))) & (begin[order] <= j) & (end[order] >= j + length)
            hit = order[later]
            first[hit] = j
            last[hit] = np.maximum(last[hit], j)
    return first, last


# ---------------------------------------------------------------- distributed
_PART = pa.schema([("key", pa.int64()), ("kind", pa.int8()), ("block", pa.int64()), *((c, pa.binary()) for c in "abcdefg")])
_PART_SQL = "key long, kind byte, block long, a binary, b binary, c binary, d binary, e binary, f binary, g binary"


def _record(*rows: tuple) -> pa.RecordBatch:
    full = [(*r, *[b""] * (10 - len(r))) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*full, strict=True), _PART, strict=True)], schema=_PART)


def _fragments(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _name(block: int) -> str:
    return f"block-{block:016x}"


def _write_blocks(docs: DataFrame, folder: str, n_fragments: int, length: int) -> DataFrame:
    """Block files with all columns of docs (c0: doc_id, c1: text), in ascending doc_id.  Kind 0, by fragment: the
    distinct anchors of a block, and whether each is there more than once.  Kind 2: one row for each block."""

    def write(parts):
        forget()
        held, size = [], 0

        def flush():
            nonlocal held, size
            table = pa.Table.from_batches(held).combine_chunks()
            table = table.take(pc.sort_indices(table, sort_keys=[("c0", "ascending"), ("c1", "ascending")]))
            held, size = [], 0
            block = uuid.uuid4().int >> 65
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            put_file(folder, _name(block), sink.getvalue().to_pybytes())
            data, offsets = utf8(table.column("c1"))
            _, h = anchors(data, offsets, length)
            h, n = np.unique(h, return_counts=True)
            edges = np.searchsorted(_fragments(h, n_fragments), np.arange(n_fragments + 1))
            yield _record((block, 2, block))
            for f in np.flatnonzero(np.diff(edges)).tolist():
                i, j = edges[f], edges[f + 1]
                yield _record((f, 0, block, pack(h[i:j]), pack(n[i:j] > 1)))
            del table, data, h, n
            trim()

        for b in parts:
            # long batches in pieces, so that a block stays near its size
            _, offsets = utf8(b.column(1))
            for i, j in runs(offsets, BLOCK):
                held.append(b.slice(i, j - i))
                size += int(offsets[j] - offsets[i])
                if size >= BLOCK:
                    yield from flush()
        if held:
            yield from flush()

    return docs.mapInArrow(write, _PART_SQL)


def _repeated_anchors(found: DataFrame, n_fragments: int) -> DataFrame:
    """Kind 0, by block: its anchors that occur twice anywhere."""

    def count(parts):
        forget()
        rows = [r for b in parts for r in b.to_pylist()]
        if not rows:
            return
        h = np.concatenate([np.frombuffer(r["a"], np.uint64) for r in rows])
        twice = np.concatenate([np.frombuffer(r["b"], bool) for r in rows])
        of = np.repeat(np.arange(len(rows)), [len(r["a"]) // 8 for r in rows])
        order = np.argsort(h, kind="stable")
        hs = h[order]
        lead = np.append(True, hs[1:] != hs[:-1])
        at = np.flatnonzero(lead)
        n = np.diff(np.append(at, len(hs)))
        some = np.repeat((n > 1) | np.logical_or.reduceat(twice[order], at), n)
        h, of = hs[some], of[order][some]
        order = np.argsort(of, kind="stable")
        h, of = h[order], of[order]
        edges = np.searchsorted(of, np.arange(len(rows) + 1))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            yield _record((rows[k]["block"], 0, rows[k]["block"], pack(h[edges[k] : edges[k + 1]])))
        del rows, h, of, order, hs, lead, some, twice
        trim()

    return dealt(found.where("kind = 0"), n_fragments).mapInArrow(count, _PART_SQL)


def _read_block(folder: str, block: int) -> pa.Table:
    return pa.ipc.open_stream(get_file(folder, _name(block))).read_all()


def _segments(shared: DataFrame, folder: str, n_fragments: int, length: int) -> DataFrame:
    """Kind 0, by fragment: anchors, doc_ids, places, texts, first and last column, 16 bytes of digest of the content,
    of the distinct segments of a block.  Kind 1, by block: ranges that equal an earlier segment of the same block."""
    left, width = length - KMER, 2 * length - KMER

    def cut(table: pa.Table) -> pa.Table:
        forget()
        block = table.column("key")[0].as_py()
        want = np.sort(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("a")]))
        docs = _read_block(folder, block)
        data, offsets = utf8(docs.column("c1"))
        ids = _ids(docs)
        p, h = anchors(data, offsets, length)
        at = np.searchsorted(want, h)
        some = want[np.minimum(at, len(want) - 1)] == h
        p, h = p[some], h[some]
        doc = np.searchsorted(offsets, p, "right") - 1
        lo, hi = offsets[doc], offsets[doc + 1]
        seg = lambda k: segments(data, p[k], lo[k], hi[k], left, width)
        sums, keys, step = np.empty(len(p), np.uint64), odd(31, -(-width // 8)), 4096
        with np.errstate(over="ignore"):
            for i in range(0, len(p), step):
                s = seg(slice(i, i + step))
                wide = np.zeros((len(s), 8 * len(keys)), np.uint8)
                wide[:, :width] = s
                sums[i : i + step] = (mix(wide.view(np.uint64)) * keys).sum(1, dtype=np.uint64)
        # a copy has the bytes of the first segment with its sum; others of that sum are kept as well
        order = np.lexsort((p, sums))
        lead = np.append(True, sums[order][1:] != sums[order][:-1]) if len(p) else np.zeros(0, bool)
        first = order[np.maximum.accumulate(np.where(lead, np.arange(len(p)), 0))] if len(p) else order
        again, of = order[~lead], first[~lead]
        same = np.ones(len(again), bool)
        for i in range(0, len(again), step):
            same[i : i + step] = (seg(again[i : i + step]) == seg(of[i : i + step])).all(1)
        copies, keep = np.sort(again[same]), np.sort(np.concatenate([order[lead], again[~same]]))
        digests = np.empty((len(keep), 2), np.uint64)
        for i in range(0, len(keep), step):
            raw = seg(keep[i : i + step]).tobytes()
            found = [hashlib.blake2b(raw[k : k + width], digest_size=16).digest() for k in range(0, len(raw), width)]
            digests[i : i + step] = np.frombuffer(b"".join(found), np.uint64).reshape(-1, 2)
        trim()
        begin, end = np.maximum(p - left, lo), np.minimum(p - left + width, hi)
        out = [(block, 1, block, pack(doc[copies].astype(np.int64)), pack((begin - lo)[copies]), pack((end - lo)[copies]))] if len(copies) else []
        frag = _fragments(h[keep], n_fragments)
        by = np.argsort(frag, kind="stable")
        keep, digests, frag = keep[by], digests[by], frag[by]
        for f in np.unique(frag).tolist():
            i, j = np.searchsorted(frag, [f, f + 1])
            k = keep[i:j]
            out.append((f, 0, block, pack(h[k]), pack(ids[doc[k]].astype(np.int64)), pack(p[k] - lo[k]), pack(doc[k].astype(np.int64)), pack((begin - p + left)[k].astype(np.uint8)), pack((end - p + left)[k].astype(np.uint8)), pack(digests[i:j])))
        return pa.Table.from_batches([_record(*out)] if out else [], schema=_PART)

    return shared.repartition(n_fragments, "key").groupBy("key").applyInArrow(cut, _PART_SQL)


def _ids(docs: pa.Table) -> np.ndarray:
    """The doc_ids; those that are null stand last, as the largest long."""
    return pc.fill_null(docs.column("c0"), (1 << 63) - 1).to_numpy()


def _columns(rows: list[dict], **kinds) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in kinds.items()]


def _distinct(found: DataFrame, n_fragments: int, length: int) -> DataFrame:
    """By block.  Kind 1: ranges of segments whose content an earlier one has.  Kind 0: texts, places and anchors of
    the first of each content, where an anchor has several: only their bytes must be compared."""
    left = length - KMER

    def pick(parts):
        forget()
        rows = []
        for b in parts:
            through = b.filter(pc.equal(b.column("kind"), 1))
            if through.num_rows:
                yield through
            rows += b.filter(pc.equal(b.column("kind"), 0)).to_pylist()
        if not rows:
            return
        h, ids, p, doc, begin, end, content = _columns(rows, a=np.uint64, b=np.int64, c=np.int64, d=np.int64, e=np.uint8, f=np.uint8, g=np.uint64)
        content = content.reshape(-1, 2)
        names = np.array([r["block"] for r in rows])[np.repeat(np.arange(len(rows)), [len(r["a"]) // 8 for r in rows])]
        del rows
        order = np.lexsort((p, doc, names, ids, content[:, 1], content[:, 0], h))
        ho, co = h[order], content[order]
        anchor = np.append(True, ho[1:] != ho[:-1])
        new = anchor | np.append(True, (co[1:] != co[:-1]).any(1))
        kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(anchor))
        several = np.repeat(kinds > 1, np.diff(np.append(np.flatnonzero(anchor), len(ho))))
        for kind, some in ((1, order[~new]), (0, order[new & several])):
            if not len(some):
                continue
            some = some[np.argsort(names[some], kind="stable")]
            blocks, at = np.unique(names[some], return_index=True)
            for name, i, j in zip(blocks.tolist(), at, np.append(at[1:], len(some)), strict=True):
                k = some[i:j]
                from_, to = (p[k] - left + begin[k], p[k] - left + end[k]) if kind else (p[k], h[k])
                yield _record((name, kind, name, pack(doc[k]), pack(from_), pack(to)))
        trim()

    return dealt(found, n_fragments).mapInArrow(pick, _PART_SQL)


def _bytes(wanted: DataFrame, folder: str, n_fragments: int, length: int) -> DataFrame:
    """Kind 0, by fragment: anchors, doc_ids, places, texts, first and last column, and bytes of the wanted segments.
    Kind 1 passes through."""
    left, width = length - KMER, 2 * length - KMER

    def cut(table: pa.Table) -> pa.Table:
        through = table.filter(pc.equal(table.column("kind"), 1))
        rows = table.filter(pc.equal(table.column("kind"), 0)).to_pylist()
        if not rows:
            return through
        block = rows[0]["key"]
        doc, place, h = _columns(rows, a=np.int64, b=np.int64, c=np.uint64)
        docs = _read_block(folder, block)
        data, offsets = utf8(docs.column("c1"))
        ids = _ids(docs)
        lo, hi = offsets[doc], offsets[doc + 1]
        p = lo + place
        begin, end = np.maximum(p - left, lo) - p + left, np.minimum(p - left + width, hi) - p + left
        frag = _fragments(h, n_fragments)
        keep = np.argsort(frag, kind="stable")
        edges = np.searchsorted(frag[keep], np.arange(n_fragments + 1))
        out = []
        for f in np.flatnonzero(np.diff(edges)).tolist():
            k = keep[edges[f] : edges[f + 1]]
            out.append((f, 0, block, pack(h[k]), pack(ids[doc[k]].astype(np.int64)), pack(place[k]), pack(doc[k]), pack(begin[k].astype(np.uint8)), pack(end[k].astype(np.uint8)), pack(segments(data, p[k], lo[k], hi[k], left, width))))
        trim()
        return pa.concat_tables([through, pa.Table.from_batches([_record(*out)], schema=_PART)])

    return wanted.repartition(n_fragments, "key").groupBy("key").applyInArrow(cut, _PART_SQL)


def _marked(found: DataFrame, n_fragments: int, length: int) -> DataFrame:
    """Kind 1, by block: ranges of its texts that repeat an earlier string."""
    left, width = length - KMER, 2 * length - KMER

    def mark(parts):
        forget()
        rows = []
        for b in parts:
            through = b.filter(pc.equal(b.column("kind"), 1))
            if through.num_rows:
                yield through
            rows += b.filter(pc.equal(b.column("kind"), 0)).to_pylist()
        if not rows:
            return
        h, ids, p, doc, begin, end, s = _columns(rows, a=np.uint64, b=np.int64, c=np.int64, d=np.int64, e=np.uint8, f=np.uint8, g=np.uint8)
        begin, end, s = begin.astype(np.int64), end.astype(np.int64), s.reshape(-1, width)
        names = np.array([r["block"] for r in rows])
        of = np.repeat(np.arange(len(rows)), [len(r["a"]) // 8 for r in rows])
        del rows
        rank = np.empty(len(h), np.int64)
        rank[np.lexsort((p, doc, names[of], ids))] = np.arange(len(h))
        trim()
        first, last = repeated(s, rank, begin, end, length)
        del s
        trim()
        hit = np.flatnonzero(first >= 0)
        if not len(hit):
            return
        hit = hit[np.argsort(names[of[hit]], kind="stable")]
        blocks, at = np.unique(names[of[hit]], return_index=True)
        for name, i, j in zip(blocks.tolist(), at, np.append(at[1:], len(hit)), strict=True):
            k = hit[i:j]
            yield _record((name, 1, name, pack(doc[k]), pack(p[k] - left + first[k]), pack(p[k] - left + last[k] + length)))

    return dealt(found, n_fragments).mapInArrow(mark, _PART_SQL)


def _cover(docs: pa.Table, ranges: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """Text bytes, starts, and which bytes the ranges (text, from, to) cover."""
    data, offsets = utf8(docs.column("c1"))
    edge = np.zeros(len(data) + 1, np.int32)
    for doc, lo, hi in ranges:
        np.add.at(edge, offsets[doc] + lo, 1)
        np.add.at(edge, offsets[doc] + hi, -1)
    return data, offsets, np.cumsum(edge[:-1], dtype=np.int32) > 0


def _plan(docs: DataFrame, length: int) -> tuple[DataFrame, str]:
    """Rows by block: kind 2 once for each block, kind 1 ranges to remove; and the folder of the block files."""
    folder = shared_path(docs.sparkSession, "blocks")
    size = docs.agg(F.sum(F.octet_length("c1"))).first()[0] or 0
    n = max(1, -(-size // FRAGMENT))
    found = written(_write_blocks(docs, folder, n, length), "anchors")
    cuts = _segments(_repeated_anchors(found, n), folder, n, length)
    ranges = _marked(_bytes(_distinct(cuts, n, length), folder, n, length), n, length)
    return found.where("kind = 2").unionByName(ranges).select("key", "kind", "a", "b", "c"), folder


def _placed(docs: DataFrame) -> DataFrame:
    """c0: doc_id, c1: text (null: empty), then all columns of docs, by place."""
    have = [c.lower() for c in docs.columns]
    fresh = docs.toDF(*[f"x{i}" for i in range(len(have))])
    doc_id, text = F.col(f"x{have.index('doc_id')}"), F.col(f"x{have.index('text')}")
    return fresh.select(doc_id.cast("long").alias("c0"), F.coalesce(text, F.lit("")).alias("c1"), *fresh.columns)


def removals(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs (doc_id long, text).

    Bytes are those of the UTF-8 text; null is empty; strings never cross texts.  A string is repeated if it also
    starts in a text of smaller doc_id or earlier in the same text.  Rows with equal doc_id are texts of their own, in
    an order that is settled once.  Null doc_ids stay null and stand last."""
    plan, folder = _plan(_placed(only(docs, "doc_id", "text")).select("c0", "c1"), length)

    def finish(table: pa.Table) -> pa.Table:
        docs, ranges = _block_rows(table, folder)
        data, offsets, gone = _cover(docs, ranges)
        before = np.append(False, gone[:-1])
        before[offsets[:-1][offsets[:-1] < len(gone)]] = False
        removed, spans = (np.append(np.int32(0), np.cumsum(x, dtype=np.int32)) for x in (gone, gone & ~before))
        removed, spans = removed[offsets[1:]] - removed[offsets[:-1]], spans[offsets[1:]] - spans[offsets[:-1]]
        trim()
        raw = data.tobytes()
        sha = []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            sha.append(hashlib.sha256(raw[a:b] if not removed[i] else data[a:b][~gone[a:b]].tobytes()).hexdigest())
        del raw, data, gone
        trim()
        return pa.Table.from_arrays([docs.column("c0"), pa.array(np.diff(offsets)), pa.array(removed.astype(np.int64)), pa.array(spans.astype(np.int64)), pa.array(sha)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return plan.groupBy("key").applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _block_rows(table: pa.Table, folder: str):
    rows = table.to_pylist()
    return _read_block(folder, rows[0]["key"]), [tuple(np.frombuffer(r[c], np.int64) for c in "abc") for r in rows if r["kind"] == 1]


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs, with the repeated bytes taken out of the text, and with n_chars, if there is such a column, counted anew.
    A character of which some bytes are gone goes as a whole.  Null texts stay null; texts that are removed as a whole
    become empty, and their rows stay."""
    have = [c.lower() for c in docs.columns]
    text, n_chars = have.index("text"), have.index("n_chars") if "n_chars" in have else None
    # the text is there as c1; of the column itself only its nulls are needed
    placed = _placed(docs).withColumn(f"x{text}", F.col(f"x{text}").isNull())
    plan, folder = _plan(placed, length)

    def finish(table: pa.Table) -> pa.Table:
        docs, ranges = _block_rows(table, folder)
        data, offsets, gone = _cover(docs, ranges)
        raw, touched = data.tobytes(), np.append(np.int32(0), np.cumsum(gone, dtype=np.int32))
        texts, null = [], docs.column(f"x{text}").to_pylist()
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            kept = raw[a:b] if touched[a] == touched[b] else data[a:b][~gone[a:b]].tobytes()
            texts.append(None if null[i] else kept.decode("utf-8", "ignore"))
        out = docs.drop_columns(["c0", "c1"]).set_column(text, f"x{text}", pa.array(texts, pa.string()))
        if n_chars is not None:
            kind = out.schema.field(n_chars).type
            out = out.set_column(n_chars, f"x{n_chars}", pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(kind))
        del table, docs, ranges, data, raw, touched, gone, texts
        trim()
        return out

    schema = T.StructType([T.StructField(f"x{i}", f.dataType) for i, f in enumerate(docs.schema.fields)])
    return plan.groupBy("key").applyInArrow(finish, schema).toDF(*docs.columns)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: what is left of every document without strings of 100 bytes that occurred before."""
    return removals(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""A trie of conversations' prefixes, by an external mergesort that knows common prefixes.

A conversation is a key: sixteen bytes for each turn (of the SHA-256 of role and text), so keys sort by turns and no
text moves.  Keys are range-partitioned.  In each partition:

1. Sorted runs are made; each entry holds how many turns it shares with the one before it and only the rest of its key.
   Runs that memory has no room for go to files in the shared folder.
2. A loser tree merges them.  Every head knows how many turns it shares with the last entry that came out; of two heads
   the one that shares more is smaller, and only if they share equally much are turns compared, from there on.
3. The merged stream keeps the path of open nodes.  An entry that shares d turns with the one before it finishes all
   nodes deeper than d.

Nodes on the path of a partition's first or last key may go on in the next one; only these (two paths a partition) are
folded by one more task, in the same way.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickframe.llm.common import get_file, only, put_file, shared_path, trim, written

#: Bytes of a turn in a key.
TURN = 16
#: Bytes of entries in a sorted run; of runs (and of finished nodes) that a task holds before it writes to files; runs
#: merged at once.
RUN, HELD, FAN = 4 << 20, 64 << 20, 64
#: Ids of one range of so many meet before the shuffle: a conversation that very many others equal is some rows.
IDS = 4096
EMPTY = hashlib.sha256(b"").digest()

Entry = tuple[bytes, int, int, int, bytes, bytes]  # key, chunk, n, least, ids, chars (8 bytes a turn)


# ---------------------------------------------------------------- runs
_HEAD = "<IIqqqI"
_HEAD_SIZE = struct.calcsize(_HEAD)


def shared_turns(a: bytes, b: bytes, at: int = 0, count: list[int] | None = None) -> int:
    """Turns at the beginning that a and b share; the first `at` are known to be."""
    most, k = min(len(a), len(b)) // TURN, at
    while k < most and a[k * TURN : (k + 1) * TURN] == b[k * TURN : (k + 1) * TURN]:
        k += 1
    if count is not None:
        count[0] += k - at + (k < most)
    return k


def encoded(entries: Iterator[tuple[int, Entry]]) -> Iterator[bytes]:
    """Front-coded records of ascending entries with the turns that each shares with the one before it."""
    for common, (key, chunk, n, least, ids, chars) in entries:
        rest = len(key) // TURN - common
        yield struct.pack(_HEAD, common, rest, chunk, n, least, len(ids)) + key[common * TURN :] + chars[common * 8 :] + ids


def decoded(file) -> Iterator[tuple[int, Entry]]:
    """The entries of a run, read one after the other."""
    key = chars = b""
    while head := file.read(_HEAD_SIZE):
        common, rest, chunk, n, least, size = struct.unpack(_HEAD, head)
        key = key[: common * TURN] + file.read(rest * TURN)
        chars = chars[: common * 8] + file.read(rest * 8)
        yield common, (key, chunk, n, least, file.read(size), chars)


def sorted_run(entries: list[Entry]) -> Iterator[tuple[int, Entry]]:
    entries.sort(key=lambda e: e[:2])
    before = b""
    for e in entries:
        yield shared_turns(before, e[0]), e
        before = e[0]


class LoserTree:
    """Merges runs of (common turns, entry).  compared: turns that were compared."""

    def __init__(self, runs: list[Iterator[tuple[int, Entry]]]):
        self._runs, self._k = runs, max(1, len(runs))
        self.compared = [0]
        #: of each run: turns shared with the last entry that came out (at first: none came), and the entry
        self._heads = [self._next(r) for r in runs] or [None]
        self._losers = [-1] * self._k
        self._winner = self._build(1) if self._k > 1 else 0

    @staticmethod
    def _next(run):
        got = next(run, None)
        return None if got is None else list(got)

    def _play(self, i: int, j: int) -> tuple[int, int]:
        """(winner, loser); the loser then knows what it shares with the winner."""
        a, b = self._heads[i], self._heads[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        if a[0] != b[0]:
            return (i, j) if a[0] > b[0] else (j, i)
        at = shared_turns(a[1][0], b[1][0], a[0], self.compared)
        x, y = a[1][0][at * TURN :][:TURN], b[1][0][at * TURN :][:TURN]
        i, j = (i, j) if (x, a[1][1], i) < (y, b[1][1], j) else (j, i)
        self._heads[j][0] = at
        return i, j

    def _build(self, node: int) -> int:
        if node >= self._k:
            return node - self._k
        winner, self._losers[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def __iter__(self) -> Iterator[tuple[int, Entry]]:
        while (head := self._heads[self._winner]) is not None:
            yield head[0], head[1]
            i = self._winner
            self._heads[i] = self._next(self._runs[i])
            node = (i + self._k) // 2
            while node >= 1:
                i, self._losers[node] = self._play(i, self._losers[node])
                node //= 2
            self._winner = i


def merged(entries: Iterator[Entry], folder: str, run: int = RUN, held: int = HELD, fan: int = FAN) -> Iterator[tuple[int, Entry]]:
    """All entries ascending, each with the turns it shares with the one before it."""
    from pyarrow import fs

    runs: list[bytes | str] = []
    pending, size, kept = [], 0, 0
    store, root = fs.FileSystem.from_uri(folder)

    def save(parts: Iterator[bytes]) -> str:
        name = f"run-{uuid.uuid4().hex}"
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            for p in parts:
                out.write(p)
        return name

    def close():
        nonlocal pending, size, kept
        data = b"".join(encoded(sorted_run(pending)))
        pending, size = [], 0
        if kept + len(data) > held:
            runs.append(save(iter([data])))
        else:
            kept += len(data)
            runs.append(data)

    def opened(r):
        return decoded(io.BytesIO(r) if isinstance(r, bytes) else store.open_input_stream(f"{root}/{r}", compression=None, buffer_size=1 << 16))

    def drop(done):
        for r in done:
            if isinstance(r, str):
                store.delete_file(f"{root}/{r}")

    for e in entries:
        pending.append(e)
        size += len(e[0]) + len(e[4]) + len(e[5]) + 100
        if size >= run:
            close()
    if pending:
        close()
    while len(runs) > fan:  # another pass over groups of runs
        group, runs = runs[:fan], runs[fan:]
        runs.append(save(encoded(iter(LoserTree([opened(r) for r in group])))))
        kept -= sum(len(r) for r in group if isinstance(r, bytes))
        drop(group)
    yield from LoserTree([opened(r) for r in runs])
    drop(runs)


# ---------------------------------------------------------------- nodes
_NODE = np.dtype([("depth", "<i8"), ("least", "<i8"), ("n", "<i8"), ("children", "<i8"), ("leaves", "<i8"), ("saved", "<i8"), ("pos", "<i8"), ("chars", "<i8"), ("has_ends", "?"), ("ends", "V32"), ("turn", "V16")])
FAR = (1 << 63) - 1


class Open:
    """A node of the open path: what its finished children and its own members have brought so far."""

    __slots__ = ("children", "chars", "least", "leaves", "n", "saved", "sha", "turn")

    def __init__(self, turn: bytes, chars: int):
        self.turn, self.chars, self.n, self.least = turn, chars, 0, FAR
        self.children = self.leaves = self.saved = 0
        self.sha = None

    def finish(self) -> None:
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * self.chars

    def take(self, child: Open) -> None:
        self.n, self.least = self.n + child.n, min(self.least, child.least)
        self.children, self.leaves, self.saved = self.children + 1, self.leaves + child.leaves, self.saved + child.saved

    def row(self, depth: int, pos: int) -> tuple:
        return depth, self.least, self.n, self.children, self.leaves, self.saved, pos, self.chars, self.sha is not None, self.sha.digest() if self.sha else EMPTY, self.turn


class Pile:
    """Rows, put one by one and read in blocks from the last to the first; beyond `held` bytes they are files."""

    def __init__(self, folder: str, held: int = HELD, block: int = 1 << 14):
        self._folder, self._most, self._block, self._name = folder, held // (block * _NODE.itemsize), block, uuid.uuid4().hex
        self._rows, self._blocks = [], []

    def put(self, row: tuple) -> None:
        self._rows.append(row)
        if len(self._rows) >= self._block:
            self._close()

    def _close(self) -> None:
        data = np.array(self._rows, _NODE)
        self._rows = []
        if len(self._blocks) < self._most:
            self._blocks.append(data)
        else:
            self._blocks.append(f"nodes-{self._name}-{len(self._blocks)}")
            put_file(self._folder, self._blocks[-1], data.tobytes())

    def backwards(self) -> Iterator[np.ndarray]:
        from pyarrow import fs

        if self._rows:
            self._close()
        while self._blocks:
            b = self._blocks.pop()
            if isinstance(b, str):
                data = np.frombuffer(get_file(self._folder, b), _NODE)
                store, root = fs.FileSystem.from_uri(self._folder)
                store.delete_file(f"{root}/{b}")
                b = data
            yield b[::-1]


def nodes_of(stream: Iterator[tuple[int, Entry]], pile: Pile) -> None:
    """Puts the nodes of an ascending stream on the pile, children before parents.  pos is -1 for a node that is whole,
    else the place, parents first, among the nodes on the paths of the stream's first and last key: these hold only
    what their whole children and their own members brought."""
    path, first, on_first, before = [Open(b"\0" * TURN, 0)], None, 0, b""

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            d, node = len(path) - 1, path.pop()
            if d <= on_first:
                pile.put(node.row(d, d))
            else:
                node.finish()
                path[-1].take(node)
                pile.put(node.row(d, -1))

    for common, (key, _, n, least, ids, chars) in stream:
        turns = len(key) // TURN
        if first is None:
            first = on_first = turns
        else:
            close(common)
            on_first = min(on_first, common)
        counts = np.frombuffer(chars, "<i8")
        for d in range(len(path), turns + 1):
            path.append(Open(key[(d - 1) * TURN : d * TURN], int(counts[d - 1])))
        top = path[-1]
        top.n, top.least = top.n + n, min(top.least, least)
        if top.sha is None:
            top.sha = hashlib.sha256(ids)
        else:
            top.sha.update(b"," + ids)
    if first is None:
        return
    for d in range(len(path) - 1, -1, -1):  # the last key's path
        pile.put(path[d].row(d, d if d <= on_first else first + d - on_first))


_OUT = "part int, pos long, depth long, least long, n long, children long, leaves long, saved long, chars long, ends binary, turn binary, parent long, parent_pos long"
_OUT_ARROW = pa.schema([("part", pa.int32()), *[(c, pa.int64()) for c in ("pos", "depth", "least", "n", "children", "leaves", "saved", "chars")], ("ends", pa.binary()), ("turn", pa.binary()), ("parent", pa.int64()), ("parent_pos", pa.int64())])


def with_parents(pile: Pile, part: int) -> Iterator[pa.RecordBatch]:
    """Rows of the pile from the last to the first: parents come before their children, so the latest node of the depth
    above is the parent."""
    latest: list[tuple[int, int]] = []  # by depth: pos and smallest member
    for rows in pile.backwards():
        parent, parent_pos = np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        for i, (d, least, pos) in enumerate(zip(rows["depth"].tolist(), rows["least"].tolist(), rows["pos"].tolist(), strict=True)):
            if d:
                parent_pos[i], parent[i] = latest[d - 1]
            del latest[d:]
            latest.append((pos, least))
        edge = (rows["pos"] >= 0) | (parent_pos >= 0)
        ends, turn = ([x.tobytes() for x in rows[c]] for c in ("ends", "turn"))
        cols = [pa.array(np.full(len(rows), part, np.int32)), *[pa.array(np.ascontiguousarray(rows[c])) for c in ("pos", "depth", "least", "n", "children", "leaves", "saved", "chars")]]
        cols += [pa.array([e if h or p < 0 else None for e, h, p in zip(ends, rows["has_ends"].tolist(), rows["pos"].tolist(), strict=True)], pa.binary()), pa.array(turn, pa.binary())]
        cols += [pa.array(parent, mask=edge), pa.array(parent_pos, mask=parent_pos < 0)]
        yield pa.RecordBatch.from_arrays(cols, schema=_OUT_ARROW)


def fold(rows: Iterator[dict]) -> Iterator[dict]:
    """The nodes of all partitions' outer paths, ordered by partition and place, as whole nodes: a row with `node` for
    each place it has (part, pos), and one with its numbers, its parent's number, and part null."""
    path: list[tuple[int, Open, bytes | None]] = []
    names = iter(range(1 << 62))

    def close(depth: int):
        while len(path) > depth:
            d, (name, node, ends) = len(path) - 1, path.pop()
            node.finish()
            if path:
                path[-1][1].take(node)
            yield {"node": name, "up": path[-1][0] if path else None, "depth": d, "least": node.least, "n": node.n, "children": node.children, "leaves": node.leaves, "saved": node.saved, "ends": ends or EMPTY}

    for r in rows:
        d = r["depth"]
        if d < len(path) and path[d][1].turn != r["turn"]:
            yield from close(d)
        if d == len(path):
            path.append((next(names), Open(r["turn"], r["chars"]), None))
        name, node, ends = path[d]
        node.n, node.least, node.saved = node.n + r["n"], min(node.least, r["least"]), node.saved + r["saved"]
        node.children, node.leaves = node.children + r["children"], node.leaves + r["leaves"]
        path[d] = name, node, ends or r["ends"]
        yield {"part": r["part"], "pos": r["pos"], "node": name}
    yield from close(0)


_FOLDED = pa.schema([("part", pa.int32()), *[(c, pa.int64()) for c in ("pos", "node", "up", "depth", "least", "n", "children", "leaves", "saved")], ("ends", pa.binary())])


# ---------------------------------------------------------------- distributed
def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (array of hex and chars) of conversations (conv_id, turn, role, text) in order of turn, null
    first; equal turns by role and the turn's hash.  Null roles and texts are empty.  Rows without a conv_id belong to
    no conversation."""
    rows = only(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.substring(F.sha2(said.cast("binary"), 256), 1, 2 * TURN)
    one = F.struct("turn", role.alias("role"), digest.alias("hex"), F.char_length(text).cast("long").alias("chars"))
    turns = F.transform(F.sort_array(F.collect_list(one)), lambda t: F.struct(t["hex"].alias("hex"), t["chars"].alias("chars")))
    return rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(turns.alias("turns"))


def prefix_trie(seqs: DataFrame, ids: int = IDS, run: int = RUN, held: int = HELD, fan: int = FAN) -> DataFrame:
    """A row for each distinct prefix of seqs (conv_id long, turns array<struct<hex, chars>>; conv_id unique), the
    empty one included: conv_id (smallest member), depth, parent_conv_id (of the parent; root: null), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.  An empty table has no nodes.

    A conversation is one entry, so its turns (24 bytes each) are in one task.  Equal conversations meet in ranges of
    ids before they move; the list of ids that end at a node is hashed as it streams by, which one task must do."""
    spark = seqs.sparkSession
    keyed = seqs.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["hex"]), "")).alias("key"), F.transform("turns", lambda t: t["chars"]).alias("chars"), F.floor(F.col("conv_id") / ids).alias("chunk"))
    members = F.array_sort(F.collect_list("conv_id"))
    entries = keyed.groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.array_join(members, ",").alias("ids"), F.first("chars").alias("chars"))
    folder = shared_path(spark, "trie-runs")

    def rows(batches):
        for b in batches:
            chars = b.column("chars")
            at, flat = chars.offsets.to_numpy(), np.asarray(chars.values, "<i8")
            for i, (key, chunk, n, least, text) in enumerate(zip(*(b.column(c).to_pylist() for c in ("key", "chunk", "n", "least", "ids")), strict=True)):
                yield key, chunk, n, least, text.encode(), flat[at[i] : at[i + 1]].tobytes()

    def build(batches):
        from pyspark import TaskContext

        pile = Pile(folder, held)
        nodes_of(merged(rows(batches), folder, run, held, fan), pile)
        yield from with_parents(pile, TaskContext.get().partitionId())
        trim()

    found = written(entries.repartitionByRange("key").mapInArrow(build, _OUT), "trie-nodes")

    def folded(batches):
        out = list(_FOLDED.names)
        held_rows: list[dict] = []
        for r in fold(x for b in batches for x in b.to_pylist()):
            held_rows.append(r)
            if len(held_rows) >= 4096:
                yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in out} for r in held_rows], _FOLDED)
                held_rows = []
        if held_rows:
            yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in out} for r in held_rows], _FOLDED)

    # two paths for each partition
    outer = found.where("pos >= 0").repartition(1).sortWithinPartitions("part", "pos")
    outer = written(outer.mapInArrow(folded, "part int, pos long, node long, up long, depth long, least long, n long, children long, leaves long, saved long, ends binary"), "trie-paths", 1)
    whole, places = outer.where("part is null"), outer.where("part is not null").select("part", F.col("pos").alias("parent_pos"), "node")
    names = whole.select("node", F.col("least").alias("parent"))
    numbers = ("least", "depth", "parent", "n", "children", "leaves", "saved", "ends")
    ends = whole.join(names.withColumnRenamed("node", "up"), "up", "left").select(*numbers)
    inner = found.where("pos < 0")
    deep = inner.where("parent_pos is null").select(*numbers)
    hung = inner.where("parent_pos is not null").drop("parent").join(places.join(names, "node"), ["part", "parent_pos"]).select(*numbers)
    every = ends.unionByName(deep).unionByName(hung)
    return every.select(
        F.col("least").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.lower(F.hex("ends")).alias("ends_sha256"))


def branched(seqs: DataFrame, group: int = 100, most: int = 5) -> DataFrame:
    """Every conversation c anew: the first h turns of conversation c - c % group, then its own from the h-th on;
    h = crc32(c in decimal) % (most + 1)."""
    heads = seqs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    d = seqs.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int"))
    d = d.join(heads, "base", "left")
    head = F.coalesce(F.expr("slice(head, 1, h)"), F.expr("slice(turns, 1, 0)"))
    return d.select("conv_id", F.concat(head, F.expr("slice(turns, h + 1, size(turns))")).alias("turns"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the prefix trie of all conversations, branched off the first of their hundred."""
    return prefix_trie(branched(sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


OP12_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, length(coalesce(text, '')) as chars,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as s from conversations where conv_id is not null),
l as (select conv_id, list(s order by turn nulls first, role, s) as s, list(chars order by turn nulls first, role, s) as c from t group by 1),
h as (
  select *, xor(4294967295, list_reduce(list_concat([4294967295], [cast(ascii(x) as bigint) for x in string_split(cast(conv_id as varchar), '')]),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 6 as h from l),
r as (
  select c.conv_id, list_concat(coalesce(b.s[1:c.h], []), c.s[c.h + 1:]) as s, list_concat(coalesce(b.c[1:c.h], []), c.c[c.h + 1:]) as c
  from h c left join l b on b.conv_id = c.conv_id - c.conv_id % 100),
p as (select conv_id, len(s) as turns, d, array_to_string(s[1:d], '') as k, array_to_string(s[1:d - 1], '') as up, coalesce(c[d], 0) as chars
  from (select *, unnest(range(0, len(s) + 1)) as d from r)),
n as (
  select k, any_value(up) as up, any_value(d) as depth, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(chars) as saved,
    sha256(coalesce(string_agg(conv_id, ',' order by conv_id) filter (turns = d), '')) as ends from p group by 1),
f as (select up as k, count(*) as children from n where depth > 0 group by 1),
u as (
  select p.k, sum(n.saved) as saved, count(*) filter (f.children is null) as leaves
  from n left join f on f.k = n.k join p on p.conv_id = n.conv_id and p.d <= n.depth group by 1)
select n.conv_id, cast(n.depth as bigint) as depth, x.conv_id as parent_conv_id, n.n_convs, coalesce(f.children, 0) as n_children, u.leaves as n_leaves,
  cast(u.saved as bigint) as saved_tokens, n.ends as ends_sha256
from n join u on u.k = n.k left join f on f.k = n.k left join n x on x.k = n.up and n.depth > 0
"""

"""Passages by difference covers, the prefix trie and ranked search against brute force, with nulls, ties, repeated rows,
long texts, empty tables and clashing extra columns."""

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wickframe.llm import covers, tries, wand

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def prose(rng, n, letters="etaoin"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(n))


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    passage = prose(rng, 60)
    rows = [(i, prose(rng, rng.randint(10, 90))) for i in range(25)]
    rows += [(100 + i, prose(rng, rng.randint(0, 30)) + " \n" + passage + "\t" + prose(rng, 15)) for i in range(8)]
    rows += [(200 + i, rows[3][1]) for i in range(5)]
    rows += [(300, None), (301, ""), (302, " \n "), (303, "one two"), (304, "a " * 70), (305, "ça Où " * 30), (306, prose(rng, 3000)), (307, "x" * 5000)]
    # windows of 20 exactly, shifted by every residue of the period
    rows += [(400 + i, prose(rng, i) + " " + " ".join(passage.split()[17:37]) + " " + prose(rng, 3)) for i in range(14)]
    return rows + [(303, "one two"), (-5, prose(rng, 30) + " " + passage)]


def brute_windows(rows, window=20):
    docs = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    seen, out = set(), []
    for i, t in docs:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            g = tuple(w[s : s + window])
            if g in seen:
                gone[s : s + window] = [True] * window
            seen.add(g)
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, k in zip(w, gone, strict=True) if not k))))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [20, 5, 9, 33])
def test_covers(spark, texts, window):
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("extra", F.lit("other")).repartition(4)
    docs = docs.toDF("doc_id", "text", "TEXT")
    got = covers.without_windows(docs, window, block=2000).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_windows(texts, window)


def test_covers_hold_every_difference():
    for v, residues in covers.COVERS.items():
        assert {(a - b) % v for a in residues for b in residues} == set(range(v))


def test_covers_null_ids_and_nothing(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f")]
    got = covers.without_windows(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    assert sorted([(r.doc_id, r.n_removed) for r in got], key=str) == [(1, 0), (None, 6), (None, 6)]
    assert covers.without_windows(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_covers_hot_passage_is_a_row_a_block(spark):
    """A passage of all documents: each block sends each of its windows once."""
    rng = random.Random(1)
    passage = prose(rng, 40)
    rows = [(i, passage + " " + prose(rng, 2)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = covers.shared_path(spark, "t")
    blocks = covers.write_blocks(docs.select("doc_id", "text"), folder)
    marks = covers.repeated_windows(blocks, folder, 20)
    assert marks.where("at is not null").count() <= 3 * 45
    assert sorted((tuple(r)[:3] for r in covers.without_windows(docs).collect()), key=str) == sorted((r[:3] for r in brute_windows(rows)), key=str)


def test_covers_a_long_text(spark):
    rng = random.Random(2)
    long = prose(rng, 400_000)
    assert len(long) > 1 << 20
    rows = [(2, long), (1, " ".join(long.split()[1000:1100])), (3, long[:5000])]
    got = covers.without_windows(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_windows(rows)


# ---------------------------------------------------------------- trie
def said(convs):
    out = defaultdict(list)
    for c, turn, role, text in convs:
        if c is not None:
            role, text = role or "", text or ""
            digest = sha(f"{len(role.encode())}:{role}{text}")[:32]
            out[c].append(((turn is not None, turn or 0), role, digest, text))
    return {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in out.items()}


def branched(seqs):
    out = {}
    for c, own in seqs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = seqs.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    return out


def brute_trie(seqs):
    members = defaultdict(list)
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out = []

    def walk(k):
        leaves, saved = 0, (len(members[k]) - 1) * len(k[-1][1]) if k else 0
        for x in kids[k]:
            a, b = walk(x)
            leaves, saved = leaves + a, saved + b
        leaves = leaves or 1
        ends = ",".join(str(c) for c in sorted(c for c in members[k] if len(seqs[c]) == len(k)))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), leaves, saved, sha(ends)))
        return leaves, saved

    if seqs:
        walk(())
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def convs():
    rng = random.Random(3)
    rows = []
    hot = [("user", "hello"), ("assistant", "hi there"), ("user", "éà"), ("assistant", "")]
    for c in [*range(0, 330), 400, 401, 1000, 100_003]:
        turns = hot[: rng.randint(1, 4)] if rng.random() < 0.4 else [(rng.choice(["user", "assistant", "", None]), rng.choice(["a", "bb", "ccc", None, "hello"])) for _ in range(rng.randint(1, 7))]
        rows += [(c, t, *x) for t, x in enumerate(turns)]
    rows += [(500, None, "user", "first"), (500, 3, "user", "x"), (500, 3, "assistant", "x"), (500, 3, "user", "x"), (None, 1, "user", "lost"), (501, 0, None, None)]
    rows += [(502, t, "user", f"turn {t % 3}") for t in range(300)]
    return rows


CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("parts", "run", "held", "fan"), [(1, 4 << 20, 64 << 20, 64), (4, 600, 2000, 3), (9, 200, 0, 2)])
def test_trie(spark, convs, parts, run, held, fan):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        d = spark.createDataFrame(convs, CONV).withColumn("extra", F.lit(1)).toDF("conv_id", "turn", "role", "text", "TEXT").repartition(5)
        got = tries.prefix_trie(tries.branched(tries.sequences(d)), ids=16, run=run, held=held, fan=fan)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(branched(said(convs)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_trie_of_nothing_and_of_equal_ones(spark):
    assert tries.prefix_trie(tries.sequences(spark.createDataFrame([], CONV))).collect() == []
    rows = [(c, t, "user", "same") for c in range(5000) for t in range(2)]
    got = tries.prefix_trie(tries.sequences(spark.createDataFrame(rows, CONV)))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(said(rows))


def test_loser_tree_compares_shared_turns_once():
    """Keys with 50 turns in common: each is compared turn by turn with a neighbour of its run, or not at all."""
    rng = random.Random(4)
    common = b"".join(bytes([k]) * 16 for k in range(50))
    keys = [common + rng.randbytes(16) for _ in range(400)]
    runs = [tries.decoded(io.BytesIO(b"".join(tries.encoded(tries.sorted_run([(k, 0, 1, 0, b"", bytes(8 * 51)) for k in keys[i::8]]))))) for i in range(8)]
    tree = tries.LoserTree(runs)
    out = list(tree)
    assert [e[0] for _, e in out] == sorted(keys)
    assert [c for c, _ in out] == [0, *[tries.shared_turns(a[1][0], b[1][0]) for a, b in zip(out[:-1], out[1:], strict=True)]]
    assert tree.compared[0] < 400 * 3 + 8 * 51


# ---------------------------------------------------------------- ranked search
def brute_ranks(rows, items, k=50):
    docs = [(i, Counter(TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")))) for i, t in rows]
    n_docs, total = sum(1 for _, c in docs if c), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        terms = set(TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")))
        found = []
        for i, c in docs:
            m = 50 + 50 * sum(c.values()) * n_docs // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def searched():
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(250)]
    weights = [1 / (k + 1) for k in range(250)]
    rows = [(i, " ".join(rng.choices(vocab, weights, k=rng.randint(1, 60)))) for i in range(900)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]
    rows += [(2000, None), (2001, ""), (2002, "-- ,"), (2003, "ÉÀ x_Y été"), (2004, "日本語 text " * 300), (None, rows[7][1]), (5, rows[5][1]), (2005, " ".join(rng.choices(vocab, weights, k=30_000)))]
    items = [(i, " ".join(rng.choices(vocab, weights, k=rng.randint(1, 30)))) for i in range(25)]
    items += [(100, rows[7][1]), (101, None), (102, "nowhere"), (103, "été É 日本語"), (104, "X_y"), (100, rows[7][1])]
    return rows, items


@pytest.mark.parametrize("size", [1 << 22, 3000])
def test_ranked(spark, searched, size):
    rows, items = searched
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.lit(1)).toDF("doc_id", "text", "TEXT").repartition(4)
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("extra", F.lit(1)).toDF("item_id", "text", "Item_Id")
    got = wand.ranked(d, q, size=size, per_block=7)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_ranks(rows, items)


def test_ranked_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert wand.ranked(docs, items).collect() == []
    assert wand.ranked(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.where("item_id > 1")).collect() == []


def test_blocks_below_the_threshold_are_not_read():
    """A rare term decides: of the common term's blocks only few are decompressed, with equal results."""
    rng = np.random.default_rng(8)
    n = 40_000
    counts = np.full(n, 2)
    hashes = np.tile(np.array([1, 2], np.uint64), n)
    hashes[1::2] = rng.integers(10, 1 << 60, n, dtype=np.uint64)
    rare = rng.choice(n, 60, replace=False)
    hashes[2 * rare + 1] = 7
    seg = wand.Segment(wand.segment(hashes, counts, pa.array(np.arange(n)), n, 2 * n))
    best = wand.Best(50)
    wand.search(seg, wand.norms(seg.counts, n, 2 * n), np.array([1, 7], np.uint64), np.array([3, 9000]), best)
    assert best.ids.tolist() == sorted(rare.tolist())[:50]
    assert seg.read < 0.5 * n / wand.BLOCK


def test_postings_come_back():
    rng = np.random.default_rng(9)
    counts = rng.integers(0, 400, 500)
    counts[3] = 100_000  # occurrences beyond two bytes
    hashes = rng.integers(0, 50, counts.sum()).astype(np.uint64)
    hashes[counts[:3].sum() : counts[:4].sum()] = 3
    seg = wand.Segment(wand.segment(hashes, counts, pa.array(np.arange(500)), 500, int(counts.sum())))
    doc = np.repeat(np.arange(500), counts)
    want = Counter(zip(hashes.tolist(), doc.tolist(), strict=True))
    for k, term in enumerate(seg.words.tolist()):
        d, tf, _ = seg.postings(np.arange(seg.first_block[k], seg.first_block[k + 1]))
        assert {(term, x): y for x, y in zip(d.tolist(), tf.tolist(), strict=True)} == {k: v for k, v in want.items() if k[0] == term}

"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its words, pairs of neighbours, pairs with one word between, and the first four, six and eight bytes
of longer words (inflected forms and compounds share them); each is there or not, hashed to 2**20 places.  Per-coordinate learning rates and
an L1 term leave few weights that are not zero; these, a bounded number, go to every task.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickframe.llm.common import IS_SPACE, LOWER, crc_mod, forget, get_file, mix, only, put_file, runs, shared_path, utf8, word_hashes

#: Labelled texts to learn from at most (a sample by hash of the doc_id); places; passes; FTRL's parameters.
TRAIN_ROWS, BITS, PASSES = 12_000, 20, 10
ALPHA, BETA, L2, BALANCE = 1.0, 1.0, 0.0, 1.0
#: L1 terms to choose from, in weights of an example of label 1 (so they grow with the sample as the gradients do), and
#: the folds of the training rows that decide: rows that are held out have no part in it.
L1_SHARES, FOLDS = (0.4, 0.8, 1.6, 3.2, 6.4), 3
#: Bytes of the heads of longer words.
HEADS = (4, 6, 8)
#: Training ignores features of fewer texts than this.
RARE = 3
THRESHOLD = 0.7


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts (with repeats) and the text of each."""
    words, starts, first = word_hashes(data, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    shift = np.uint64(64 - bits)
    with np.errstate(over="ignore"):
        parts, docs = [words >> shift], [doc]
        for gap, seed in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
            if len(words) > gap:
                pair = mix(words[:-gap] * np.uint64(seed) + words[gap:])
                same = doc[:-gap] == doc[gap:]
                parts.append(pair[same] >> shift)
                docs.append(doc[:-gap][same])
        ends = np.append(offsets[1:], len(data))[doc] if len(doc) else np.zeros(0, np.int64)
        at, of, head, have = starts, doc, np.zeros(len(starts), np.uint64), 0
        for size in HEADS:
            inside = at + size < ends[: len(at)]
            at, of, head, ends = at[inside], of[inside], head[inside], ends[inside]
            more = [LOWER[data[at + k]] for k in range(have, size + 1)]
            long = ~np.logical_or.reduce([IS_SPACE[x] for x in more]) if len(at) else np.zeros(0, bool)
            at, of, ends = at[long], of[long], ends[long]
            head = head[long] + sum(x[long].astype(np.uint64) << np.uint64(8 * (have + k)) for k, x in enumerate(more[:-1]))
            parts.append(mix(head + np.uint64(0x517CC1B727220A95) * np.uint64(size)) >> shift)
            docs.append(of)
            have = size
    return np.concatenate(parts).astype(np.int64), np.concatenate(docs)


def of_ones(labels: np.ndarray, balance: float = BALANCE) -> float:
    """What an example of label 1 counts."""
    ones = max(1, int(labels.sum()))
    return max(1.0, (len(labels) - ones) / ones) ** balance


def ftrl(rows: list[np.ndarray], labels: np.ndarray, n: int, passes: int = PASSES, alpha: float = ALPHA, beta: float = BETA, l1: float = 24.0, l2: float = L2, balance: float = BALANCE) -> tuple[np.ndarray, float]:
    """Weights and bias.  rows: each example's feature places, without repeats.  The bias has no L1 term.  Examples of
    label 1 count as much more as there are fewer of them, to the power `balance`."""
    weigh = of_ones(labels, balance)
    z, s = np.zeros(n + 1), np.zeros(n + 1)
    penalty = np.full(n + 1, l1)
    penalty[n] = 0.0

    def weight(i):
        zi = z[i]
        return np.where(np.abs(zi) <= penalty[i], 0.0, -(zi - np.sign(zi) * penalty[i]) / ((beta + np.sqrt(s[i])) / alpha + l2))

    for _ in range(passes):
        for row, y in zip(rows, labels, strict=True):
            i = np.append(row, n)
            w = weight(i)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y) * (weigh if y else 1.0)
            sigma = (np.sqrt(s[i] + g * g) - np.sqrt(s[i])) / alpha
            z[i] += g - sigma * w
            s[i] += g * g
    w = weight(np.arange(n + 1))
    return w[:n], float(w[n])


def fitted(rows: list[np.ndarray], labels: np.ndarray, share: float, bits: int = BITS, **how) -> tuple[np.ndarray, np.ndarray, float]:
    """Places, weights that are not zero, and bias, with an L1 term of `share` weights of an example of label 1.
    Features of fewer texts than RARE are ignored."""
    seen = np.bincount(np.concatenate(rows), minlength=1 << bits) if rows else np.zeros(1 << bits, np.int64)
    kept = np.flatnonzero(seen >= RARE)
    place = np.full(1 << bits, -1)
    place[kept] = np.arange(len(kept))
    w, bias = ftrl([p[p >= 0] for p in (place[r] for r in rows)], labels, len(kept), l1=share * of_ones(labels, how.get("balance", BALANCE)), **how)
    some = np.flatnonzero(w)
    return kept[some], w[some], bias


def judged(rows: list[np.ndarray], labels: np.ndarray, model: tuple[np.ndarray, np.ndarray, float], bits: int = BITS) -> tuple[int, int, int]:
    """Of examples: label 1 found at THRESHOLD, others found, and label 1 not found."""
    place, weight, bias = model
    table = np.zeros(1 << bits)
    table[place] = weight
    hit = np.array([bias + table[r].sum() for r in rows]) >= np.log(THRESHOLD / (1 - THRESHOLD))
    return int((hit & (labels > 0)).sum()), int((hit & (labels == 0)).sum()), int((~hit & (labels > 0)).sum())


def learn(labelled: DataFrame, bits: int = BITS, share: float | None = None, **how) -> tuple[np.ndarray, np.ndarray, float]:
    """Places, weights that are not zero, and bias, from a bounded table of (doc_id, text, toxic).

    One task makes the examples' features, which go to a file; the L1 term (unless given as `share`) is the one of
    L1_SHARES that gives the best F1 at THRESHOLD over FOLDS parts of these rows, each judged by a fit to the others, a
    task for every fit; among equals the middle one, then the larger.  The last fit is to all rows."""
    spark, folder = labelled.sparkSession, shared_path(labelled.sparkSession, "toxicity")

    def gather(parts):
        forget()
        rows, labels, folds = [], [], []
        for batch in parts:
            data, offsets = utf8(batch.column(0))
            labels += batch.column(1).to_pylist()
            folds += batch.column(2).to_pylist()
            for i, j in runs(offsets):
                at = offsets[i : j + 1]
                f, doc = features(data[at[0] : at[-1]], at - at[0], bits)
                both = np.unique(doc << bits | f)
                rows += np.split((both & ((1 << bits) - 1)).astype("<i4"), np.searchsorted(both >> bits, np.arange(1, j - i)))
        if rows:
            head = np.array([[len(r) for r in rows], labels, folds], "<i4")
            name = uuid.uuid4().hex
            put_file(folder, name, np.array([len(rows)], "<i8").tobytes() + head.tobytes() + np.concatenate(rows).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    def examples(name):
        raw = get_file(folder, name)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        sizes, labels, folds = np.frombuffer(raw, "<i4", 3 * n, 8).reshape(3, n)
        return np.split(np.frombuffer(raw, "<i4", offset=8 + 12 * n), np.cumsum(sizes)[:-1]), labels.astype(float), folds

    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")
    ordered = labelled.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "toxic", "text")
    made = ordered.select("text", "toxic", fold).mapInArrow(gather, "name string").collect()
    if not made:
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    name = made[0]["name"]

    def tried(parts):
        forget()
        rows, labels, folds = examples(name)
        for batch in parts:
            for c, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = folds == k
                pick = lambda some: ([r for r, m in zip(rows, some, strict=True) if m], labels[some])
                found = judged(*pick(mine), fitted(*pick(~mine), c, bits, **how), bits)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (c, *found)], ["share", "hits", "others", "missed"])

    def last(parts):
        forget()
        for batch in parts:
            for c in batch.column(0).to_pylist():
                rows, labels, _ = examples(name)
                place, weight, bias = fitted(rows, labels, c, bits, **how)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(place, -1)), pa.array(np.append(weight, bias))], ["place", "weight"])

    if share is None:
        grid = [(c, k) for c in L1_SHARES for k in range(FOLDS)]
        fits = spark.createDataFrame(grid, "share double, fold int").repartition(len(grid))
        counts = fits.mapInArrow(tried, "share double, hits long, others long, missed long").groupBy("share").agg(F.sum("hits").alias("hits"), F.sum("others").alias("others"), F.sum("missed").alias("missed")).collect()
        middle = L1_SHARES[len(L1_SHARES) // 2]
        share = max(counts, key=lambda r: (2 * r.hits / max(1, 2 * r.hits + r.others + r.missed), r.share == middle, r.share))["share"]
    got = spark.createDataFrame([(share,)], "share double").repartition(1).mapInArrow(last, "place long, weight double").toArrow()
    place, weight = got.column("place").to_numpy(), got.column("weight").to_numpy()
    return place[place >= 0], weight[place >= 0], float(weight[place < 0][0])


def sample(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text, toxic of labelled rows, about train_rows at most.  A document with several labels has the highest;
    null texts and labels are left out.  The labels are sampled before the join, so the broadcast side is bounded."""
    marked = only(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marked.count()
    if n > train_rows:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * train_rows / n))
    return only(docs, "doc_id", "text").where("text is not null").join(F.broadcast(marked), "doc_id")


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int = BITS) -> DataFrame:
    """doc_id, score of every row: the probability, from the whole text, that it's toxic.  Null and empty texts, and
    those without any known feature, have that of the bias."""
    place, weight, bias = model
    rows = only(docs, "doc_id", "text")

    def score(parts):
        forget()
        table = np.zeros(1 << bits, np.float32)
        table[place] = weight
        for batch in parts:
            data, offsets = utf8(batch.column(1))
            out = np.full(len(offsets) - 1, bias)
            for i, j in runs(offsets):
                at = offsets[i : j + 1]
                f, doc = features(data[at[0] : at[-1]], at - at[0], bits)
                some = table[f] != 0
                both = np.unique(doc[some] << bits | f[some])
                out[i:j] += np.bincount(both >> bits, table[both & ((1 << bits) - 1)], minlength=j - i)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))], ["doc_id", "score"])

    return rows.mapInArrow(score, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: learns from labels of documents that are not held out, and scores all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = only(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "toxic").where(crc_mod(F.col("doc_id"), 3) != 1)
    out = scored(docs, learn(sample(docs, labels)))
    return out.select("doc_id", (F.coalesce(crc_mod(F.col("doc_id"), 3), F.lit(0)) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

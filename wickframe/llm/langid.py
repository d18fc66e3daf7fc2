"""Language identification with bit-sliced Bloom filters of n-grams.

Every slot of the filter holds one bit for each language, so ANDing the slots of an n-gram's hashes gives, at once,
the set of all languages whose frequent n-grams include it.  A text's n-grams give each language a count of bits;
what the filter's fill makes expect by chance is taken off, and the language with the largest count wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wickframe.llm.common import crc_mod, forget, mix, only, runs, utf8

#: Labelled texts to learn from at most (a sample by hash of the doc_id), n-grams kept for each language at most,
#: slots of the filter, hashes.
TRAIN_ROWS, GRAMS, SLOTS, HASHES = 20_000, 20_000, 1 << 19, 2
#: An n-gram is entered for a language if its rate there is this share of its highest rate in any language.
SHARE = 0.3
#: A text of which the winner has less than this share of the n-grams is in none of the languages.
LEAST = 0.2

#: Bytes that are not letters become spaces; those of longer UTF-8 sequences stay.
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All runs of four bytes inside each (lower-case) text, as 32-bit numbers, and each text's first (and the end).
    A text of n bytes has max(0, n - 1) of them: it's taken with a space before and after."""
    n_docs, n = len(offsets) - 1, len(data)
    padded = np.full(n + 2 * n_docs, 32, np.uint8)
    at = np.arange(n) + 1 + 2 * np.repeat(np.arange(n_docs), np.diff(offsets))
    padded[at] = _LETTERS[data]
    wide = padded.astype(np.uint32)
    if len(wide) < 4:
        return np.zeros(0, np.uint32), np.zeros(n_docs + 1, np.int64)
    g = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
    starts = offsets + 2 * np.arange(n_docs + 1)
    count = np.maximum(np.diff(starts) - 3, 0)
    ends = starts[1:]
    inside = np.ones(len(g), bool)
    for back in (3, 2, 1):  # those that would run into the next text
        cut = ends[:-1] - back
        inside[cut[(cut >= 0) & (cut < len(g))]] = False
    return g[inside], np.concatenate([[0], np.cumsum(count)])


def _slots(g: np.ndarray, slots: int, hashes: int):
    h = mix(g.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for k in range(hashes):
        yield ((h >> np.uint64(20 * k)) & np.uint64(slots - 1)).astype(np.int64)


@dataclass
class Filters:
    """The filters of all languages: slices[w][slot] has the bits of languages 64 w to 64 w + 63."""

    languages: list[str]
    slices: list[np.ndarray]
    chance: np.ndarray  # of an n-gram found by accident, for each language
    hashes: int

    @classmethod
    def build(cls, by_language: dict[str, np.ndarray], slots: int = SLOTS, hashes: int = HASHES) -> Filters:
        languages = sorted(by_language)
        slices = [np.zeros(slots, np.uint64) for _ in range(-(-len(languages) // 64))]
        fill = np.zeros(len(languages))
        for k, name in enumerate(languages):
            bit = np.uint64(1 << (k % 64))
            for s in _slots(by_language[name].astype(np.uint32), slots, hashes):
                slices[k // 64][s] |= bit
            fill[k] = ((slices[k // 64] & bit) != 0).mean()
        narrow = np.uint8 if len(languages) <= 8 else np.uint64
        return cls(languages, [s.astype(narrow) for s in slices], fill**hashes, hashes)

    def containing(self, g: np.ndarray) -> list[np.ndarray]:
        """For each n-gram, the bits of all languages that (seem to) have it."""
        out = None
        for s in _slots(g, len(self.slices[0]), self.hashes):
            found = [x[s] for x in self.slices]
            out = found if out is None else [a & b for a, b in zip(out, found, strict=True)]
        return out

    def counts(self, g: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Corrected number of each text's n-grams that each language has: texts by languages."""
        n = np.diff(first)
        out = np.zeros((len(n), len(self.languages)))
        if not len(g) or not self.languages:
            return out
        masks, some = self.containing(g), n > 0
        at = first[:-1][some]
        for k in range(len(self.languages)):
            bits = ((masks[k // 64] >> masks[k // 64].dtype.type(k % 64)) & 1).astype(np.uint8)
            out[some, k] = np.add.reduceat(bits, at, dtype=np.int64)
        return np.maximum((out - n[:, None] * self.chance) / (1 - self.chance), 0)


def learn(docs: DataFrame, train_rows: int = TRAIN_ROWS, n_grams: int = GRAMS, slots: int = SLOTS, hashes: int = HASHES) -> Filters:
    """Filters from rows of docs (doc_id, text, lang) with text and lang, of which a hash of the doc_id picks about
    train_rows at most.  What comes to the driver is at most n_grams rows for each language."""
    rows = only(docs, "doc_id", "text", "lang").where("text is not null and lang is not null")
    n = rows.select("doc_id").count()
    if n > train_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * train_rows / n))

    def count(parts):
        forget()
        found: dict[str, list] = {}
        for batch in parts:
            lang = np.array(batch.column(1).to_pylist(), object)
            data, offsets = utf8(batch.column(0))
            for i, j in runs(offsets):
                at = offsets[i : j + 1]
                g, first = grams(data[at[0] : at[-1]], at - at[0])
                of = np.repeat(np.arange(i, j), np.diff(first))
                for name in set(lang[i:j]):
                    found.setdefault(name, []).append(np.unique(g[(lang == name)[of]], return_counts=True))
        for name, parts_ in found.items():
            all_g, where = np.unique(np.concatenate([g for g, _ in parts_]), return_inverse=True)
            total = np.bincount(where, np.concatenate([c for _, c in parts_])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(all_g), pa.string()), pa.array(all_g.astype(np.int64)), pa.array(total)], ["lang", "gram", "n"])

    counted = rows.select(F.lower("text").alias("text"), "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_lang = Window.partitionBy("lang")
    top = counted.withColumn("rate", F.col("n") / F.sum("n").over(by_lang)).withColumn("k", F.row_number().over(by_lang.orderBy(F.desc("n"), "gram"))).where(F.col("k") <= n_grams)
    got = top.select("lang", "gram", "rate").toArrow()
    lang, gram, rate = np.array(got.column("lang").to_pylist(), object), got.column("gram").to_numpy().astype(np.uint32), got.column("rate").to_numpy()
    _, where = np.unique(gram, return_inverse=True)
    best = np.zeros(int(where.max()) + 1 if len(where) else 0)
    np.maximum.at(best, where, rate)
    keep = rate >= SHARE * best[where]
    return Filters.build({name: gram[keep & (lang == name)] for name in set(lang)}, slots, hashes)


def _predict(text: pa.Array, letters: np.ndarray, filters: Filters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the language (-1: und), score and coverage of each (lower-case) text."""
    data, offsets = utf8(text)
    n = len(offsets) - 1
    pred, score, coverage = np.full(n, -1), np.zeros(n), np.zeros(n)
    for i, j in runs(offsets):
        at = offsets[i : j + 1]
        g, first = grams(data[at[0] : at[-1]], at - at[0])
        c = filters.counts(g, first)
        if c.shape[1]:
            most, total = c.max(1), c.sum(1)
            pred[i:j], score[i:j], coverage[i:j] = c.argmax(1), most / np.where(total > 0, total, 1), most / np.maximum(np.diff(first), 1)
    pred[~letters], score[~letters], coverage[~letters] = -1, 0, 0
    return pred, score, coverage


def _inputs() -> tuple:
    """Of a column `text`: its lower case, and whether it has a letter."""
    return F.lower(F.coalesce("text", F.lit(""))).alias("lower_text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score, coverage of every row, from the whole text alone.  Score is the winner's share of all
    languages' counts; coverage its share of the text's n-grams.  `und` with score 0 if text is null or has no letter,
    or if nothing was learned; equal counts go to the language that sorts first."""
    rows = only(docs, "doc_id", "text").select("doc_id", *_inputs())
    names = np.array([*filters.languages, "und"], object)

    def predict(parts):
        forget()
        for b in parts:
            pred, score, coverage = _predict(b.column(1), np.array(b.column(2).to_pylist(), bool), filters)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[pred], pa.string()), pa.array(score), pa.array(coverage)], ["doc_id", "lang_pred", "score", "coverage"])

    return rows.mapInArrow(predict, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double, coverage double")


def accepted(docs: DataFrame, filters: Filters, least_coverage: float = LEAST) -> DataFrame:
    """The rows of docs, unchanged, whose text is in one of the known languages: not `und`, and that language has at
    least this share of its n-grams.  Without any known language, all rows with letters are accepted."""
    have = [c.lower() for c in docs.columns]
    fresh = docs.toDF(*[f"x{i}" for i in range(len(have))])
    rows = fresh.withColumn("text", F.col(f"x{have.index('text')}")).select(*fresh.columns, *_inputs()).where("letters")

    def keep(parts):
        forget()
        for b in parts:
            n = b.num_columns - 2
            pred, _, coverage = _predict(b.column(n), np.ones(b.num_rows, bool), filters)
            good = (pred >= 0) & (coverage >= least_coverage) if filters.languages else np.ones(b.num_rows, bool)
            yield b.select(range(n)).filter(pa.array(good))

    return rows.mapInArrow(keep, fresh.schema).toDF(*docs.columns)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: learns from the documents that are not held out, and predicts all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, learn(docs.where(crc_mod(F.col("doc_id"), 4) != 2)))
    return out.select("doc_id", (F.coalesce(crc_mod(F.col("doc_id"), 4), F.lit(0)) == 2).alias("held_out"), "lang_pred", "score", "coverage")

"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables and
clashing extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wickframe.llm import chat, fingerprint, jaccard, langid, mixing, packing, suffixes, token_files, tokens, topk, toxicity
from wickframe.llm.common import utf8

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def prose(rng, n, letters="etaoins"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(30, 120)) for _ in range(30)]
    passage = prose(rng, 60)
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 5], "en", "s0") for i in range(12)]  # exact copies
    for i in range(15):  # near copies
        w = base[20].split()
        w[rng.randrange(len(w))] = "zzz"
        rows.append((200 + i, " ".join(w), None, "s1"))
    rows += [(300 + i, prose(rng, 20) + " " + passage + "\n" + prose(rng, 20), "en", None) for i in range(6)]
    rows += [(400, None, "en", "s0"), (401, "", None, None), (402, "  \n ", "en", "s1"), (403, "one two", "en", "s2"), (404, "ONE two", "en", "s2"), (405, "été où ça", "fr", "s2"), (406, "a" * 450, "en", "s1"), (407, prose(rng, 4000), "en", "s1"), (408, "日本語のテキスト" * 30, None, "s0"), (403, "one two", "en", "s2")]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOC).repartition(3).cache()


@pytest.fixture(scope="module")
def clashing(docs):
    """Extra columns, among them names that differ from others by case only, or not at all."""
    return docs.withColumn("extra", F.lit(1)).toDF("doc_id", "text", "lang", "source", "n_chars", "Source")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOC)


# ---------------------------------------------------------------- token ids
def test_encoder_equals_the_library(corpus):
    from tokenizers import Tokenizer

    whole, e = Tokenizer.from_file(tokens.default_path()), tokens.Encoder(tokens.default_path())
    hard = ["a  b", " a", "it's  x ", "\n a \n\n b", "a<|endoftext|> b <|endoftext|>", "é    x y", "tab\t x", "\x1c a\x1d b", "a \x1c b x", "a\nb", "\na", "a.\nB. c", "²a. b²,", "a b c　d", "don't. it's, x", "", "x\n", "😀 😀a. 1,2 3.\n4"]
    texts = hard + [t or "" for _, t, *_ in corpus]
    for _ in range(2):
        assert [x.tolist() for x in e.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_round_trip(spark, corpus, clashing, tmp_path):
    folder = f"file://{tmp_path}/ids"
    got = token_files.read_token_files(token_files.write_token_files(clashing, folder), folder).orderBy("start").collect()
    e = tokens.Encoder(tokens.default_path())
    want = [(i, np.append(e.encode([t or ""])[0], 0)) for i, t, *_ in sorted(corpus, key=lambda r: r[0])]
    assert [r.doc_id for r in got] == [i for i, _ in want]
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted((i, len(x), zlib.crc32(x.astype("<u4").tobytes())) for i, x in want)
    ends = np.cumsum([r.n_tokens for r in got])
    assert [r.start for r in got] == [0, *ends[:-1]]


def test_reader_decompresses_only_what_is_asked_for(monkeypatch):
    import io

    class Sized(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    out = io.BytesIO()
    w = token_files.Writer(out, frame=64)
    for i in range(50):
        w.add(None if i == 7 else i, np.arange(i % 9, dtype=np.uint32) + i)
    w.close()
    r = token_files.Reader(Sized(out.getvalue()))
    assert r.find(33)[0].tolist() == list(range(33, 33 + 33 % 9)) and r.frames_read == 1 and len(r.seek) > 5
    assert r.find(7) == [] and r.ids(7).tolist() == list(range(7, 14))
    monkeypatch.setattr(token_files, "DOC_ROWS", 8)  # the list of documents in several frames
    again = io.BytesIO()
    w = token_files.Writer(again, frame=64)
    for i in range(50):
        w.add(i, np.arange(i % 9, dtype=np.uint32) + i)
    w.close()
    assert [x.tolist() for x in map(token_files.Reader(Sized(again.getvalue())).ids, range(50))] == [list(range(i, i + i % 9)) for i in range(50)]
    broken = bytearray(out.getvalue())
    broken[20] ^= 255
    with pytest.raises(token_files.CorruptFile):
        bad = token_files.Reader(Sized(bytes(broken)))
        [bad.ids(i) for i in range(50)]


def test_token_files_of_nothing(nothing, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert token_files.read_token_files(token_files.write_token_files(nothing, folder), folder).count() == 0


# ---------------------------------------------------------------- packing
def test_packing_is_whole_and_tight(corpus, clashing):
    rows = packing.pack_documents(clashing, capacity=64).collect()
    e = tokens.Encoder(tokens.default_path())
    ids = defaultdict(list)
    for i, t, *_ in corpus:
        ids[i].append(np.append(e.encode([t or ""])[0], 2))
    for i, texts in ids.items():
        mine = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i)
        want = []
        for x in texts:
            at, k = 0, 0
            while at < len(x):
                n = (len(x) - at) % 64 or 64
                want.append((k, at, n, zlib.crc32(x[at : at + n].astype("<u4").tobytes())))
                at, k = at + n, k + 1
        assert mine == sorted(want)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(spans[-1]) <= 64
    assert len(by) <= 1.03 * sum(r.length for r in rows) / 64 + 2


def test_sequences_follow_positions(spark):
    rng = random.Random(8)
    texts = [prose(rng, rng.randint(1, 90)) for _ in range(400)]
    rows = [(i % 300, t, 5000 * (k // 2) + 100 * k) for k, (i, t) in enumerate(zip(rng.sample(range(400), 400), texts, strict=True))]
    pieces = packing.tokenized_pieces(spark.createDataFrame(rows, "doc_id long, text string, at long"), 64, position="at")
    got = packing.pack(pieces, 64, shard=100, generations=2).collect()
    assert {r.position for r in got} == {at for *_, at in rows} and len(got) == pieces.count()
    shards = defaultdict(list)
    for r in got:
        shards[r.sequence_id >> 24].append(r.position)
    spans = sorted((min(p), max(p)) for p in shards.values())
    assert len(spans) >= 5 and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    first = {}
    for r in got:
        first[r.sequence_id] = min(first.get(r.sequence_id, r.position), r.position)
    assert [first[k] for k in sorted(first)] == sorted(first.values())


def test_evolution_beats_best_fit():
    """Triples that fill a bin exactly: best fit by descending size wastes bins."""
    rng = np.random.default_rng(1)
    sizes = []
    for _ in range(40):
        x, y = rng.integers(26, 48, 2)
        sizes += [x, y, 100 - x - y] if 26 <= 100 - x - y <= 49 else [33, 33, 34]
    sizes = np.array(sizes)
    one = packing.first_packing(sizes, 100)
    best = packing.evolve(sizes, [], 100, rng, generations=150, seeded=True)[0]
    assert packing.fitness(best, sizes, 100) < packing.fitness(one, sizes, 100)
    assert np.bincount(best, sizes).max() <= 100 and len(best) == len(sizes)


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 60, 200)
    a, b = packing.first_packing(sizes, 64), packing.first_packing(sizes, 64, rng)
    c = packing.crossover(a, b, sizes, 64, rng)
    assert len(c) == 200 and np.bincount(c, sizes).max() <= 64 and np.bincount(c, sizes).min() > 0


def test_packing_of_nothing(nothing):
    assert packing.pack_documents(nothing).count() == 0


# ---------------------------------------------------------------- chat
CONV = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark):
    hard = ["", None, "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user<|im_sep|>", "\\", "\\<|", "<\\|im_end|>", "<<SYS>> <</SYS>> <s>", "a\nb", "😀\\\\n", "<|" * 50]
    rows = [(c, t, role, hard[(c + t) % len(hard)]) for c in range(11) for t, role in enumerate(["system", "user", "assistant", "user", "assistant", None][: 1 + c % 6])]
    rows += [(20, 1, "us<|er", "x"), (20, None, "assistant", "first"), (21, 1, "assistant", "b"), (21, 1, "assistant", "a"), (21, 1, "assistant", "a"), (None, 0, "user", "y"), (None, 1, "assistant", "z")]
    df = spark.createDataFrame(rows, CONV).withColumn("Text2", F.lit(0)).toDF("conv_id", "turn", "role", "text", "ROLE")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted_turns(df)).collect()}
    convs = defaultdict(list)
    for c, t, role, text in rows:
        convs[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.n_examples == sum(role == "assistant" for _, role, _ in turns)


def test_examples_hold_all_turns_before_the_reply(spark):
    rows = [(1, t, role, f"{role}{t}") for t, role in enumerate(["user", "assistant", "user", "assistant", "user"])]
    turns = chat.formatted_turns(spark.createDataFrame(rows, CONV))
    got = chat.written_out(turns).orderBy(F.col("target_turn").asc_nulls_last()).collect()
    assert [r.target_turn for r in got] == [2, 4, None]
    assert [r.text[r.loss_start : r.loss_end] for r in got] == ["assistant1", "assistant3", ""]
    assert got[1].text.startswith(got[0].text) and got[2].text.startswith(got[1].text) and got[2].text.count(chat.START) == 5
    assert not re.search(r"</s>|\[INST\]", "".join(r.text for r in got))


def test_loss_is_what_lies_under_the_mask(spark):
    """A mask that is off by a character, and a transcript that lacks one, show in what is read back."""
    rows = [(1, t, role, f"{role} {t} <s> \\\\ x") for t, role in enumerate(["user", "assistant", "user", "assistant"])]
    turns = chat.formatted_turns(spark.createDataFrame(rows, CONV))
    spans, lines = chat.examples(turns), chat.transcripts(turns)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = [text for *_, role, text in rows if role == "assistant"]
    one = chat.read_output(lines, spans).first()
    assert (one.loss_chars, one.loss_sha256) == (sum(map(len, texts)), sha("".join(texts)))
    assert one.formatted_chars == sum(len(r.text) for r in chat.written_out(turns).collect())
    late = spans.withColumn("loss_start", F.col("loss_start") + 1)
    assert chat.read_output(lines, late).first().loss_sha256 == sha("".join(t[1:] for t in texts))
    short = spans.withColumn("loss_end", F.col("loss_end") - 1)
    assert chat.read_output(lines, short).first().loss_sha256 == sha("".join(t[:-1] for t in texts))
    assert chat.read_output(lines.withColumn("formatted", F.expr("substring(formatted, 2)")), spans).first().turns_sha256 != one.turns_sha256


def test_chat_of_nothing(spark):
    assert chat.read_back(chat.formatted_turns(spark.createDataFrame([], CONV))).count() == 0


# ---------------------------------------------------------------- mixing
def test_mix_meets_its_targets(corpus, clashing, docs):
    rows = mixing.mixed(docs).collect()
    assert len(rows) == len(corpus)
    sizes, most = Counter(), Counter()
    for _, t, _, s, _ in corpus:
        n = len(WORD.findall(t or ""))
        sizes[s] += n
        most[s] = max(most[s], n)
    names = sorted(sizes, key=lambda s: (s is None, s))
    total, level, target = 1.5 * sum(sizes.values()), None, {}
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    open_ = list(names)
    while True:  # what is above a cap goes to the others
        level = (total - sum(target.values())) / sum(weights[s] for s in open_)
        over = [s for s in open_ if level * weights[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            open_.remove(s)
    target |= {s: level * weights[s] for s in open_}
    by = defaultdict(int)
    source = {(i, len(WORD.findall(t or ""))): s for i, t, _, s, _ in corpus}
    for r in rows:
        s = source[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and r.taken in (0, r.size, 2 * r.size)
        assert all(0 <= p <= 1 + 1e-9 for p in r.positions) and len(r.positions) == r.repeats
        by[s] += r.taken
    for s in names:
        assert abs(by[s] - target[s]) <= most[s]
    again = mixing.mixed(clashing.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_positions_follow_the_schedule(spark):
    """A source whose weight rises is rare early on: its share of taken words up to t is the integral of its weight."""
    rows = [(i, "w " * 10, None, "a", 0) for i in range(600)]
    p = sorted(x for r in mixing.mixed(spark.createDataFrame(rows, DOC), shapes=((0.0, 1.0, 2.0),)).collect() for x in r.positions)
    for q in (0.25, 0.5, 0.75):
        assert sum(x <= q for x in p) / len(p) == pytest.approx(q * q, abs=0.01)


def test_training_order_is_sorted_and_documents_come_as_often_as_taken(docs):
    m = mixing.mixed(docs)
    order = [r.position for r in mixing.training_order(m).collect()]
    assert order == sorted(order) and len(order) == sum(r.repeats for r in m.collect())
    assert mixing.mixed_documents(docs.dropDuplicates(["doc_id"])).columns == docs.columns


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_mixed_documents_are_the_mix_in_order(spark, corpus, broadcast_rows):
    """Over several ranges; with repeated, missing and huge doc_ids, and a source of one document."""
    rows = [*corpus, (2**60, "big id", "en", "s1", 6), (None, "no id a b", "en", "s2", 9), (None, "no id c", "en", "s2", 7), (5, "x y z", "en", "s1", 5), (900, "alone " * 50, "en", "zz", 300)]
    df = spark.createDataFrame(rows, DOC).repartition(3)
    out = mixing.mixed_documents(df.toDF("doc_id", "text", "lang", "source", "LANG"), broadcast_rows=broadcast_rows, n_ranges=7)
    assert out.columns == ["doc_id", "text", "lang", "source", "LANG"]
    got = out.collect()
    takes = [(p, -1 if r.doc_id is None else r.doc_id, r.size) for r in mixing.mixed(df).collect() for p in r.positions]
    assert Counter((-1 if r[0] is None else r[0], len(WORD.findall(r[1] or ""))) for r in got) == Counter(t[1:] for t in takes)
    place = defaultdict(list)
    for p, i, n in takes:
        place[i, n].append(p)
    seen, last = defaultdict(int), -1.0
    for r in got:  # every row stands where one of its takes does
        k = (-1 if r[0] is None else r[0], len(WORD.findall(r[1] or "")))
        p = sorted(place[k])[seen[k]]
        seen[k] += 1
        assert p >= last - 1e-9
        last = max(last, p)
    parts = out.rdd.glom().map(len).collect() if broadcast_rows else []
    assert not parts or sum(x > 0 for x in parts) >= 4


def test_mix_of_nothing(nothing):
    assert mixing.mixed(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


# ---------------------------------------------------------------- fingerprints
def omh(text):
    return re.findall(r"[^\x20\x09-\x0D]{1,8}", text), 3, 32


def prints(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.p for r in fingerprint.with_fingerprint(df, "text", "p").orderBy("i").collect()]


def test_fingerprint_equals_a_sequential_one(spark):
    """Same k-mers, occurrence numbers, bins and order, with the hash values taken from Spark."""
    rng = random.Random(1)
    texts = ["", "a", "abcabcabc", prose(rng, 3), prose(rng, 60), " ".join(["x y z w"] * 40), "  " + prose(rng, 200) + "\n", "été 😀 " * 12]
    got = prints(spark, texts)

    def hashes(values, expr, schema):
        if not values:
            return []
        df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], f"i int, {schema}")
        return [r.h for r in df.selectExpr("i", f"{expr} h").orderBy("i").collect()]

    mask = (1 << 24) - 1
    for text, p in zip(texts, got, strict=True):
        toks, k, bins = omh(text)
        h = hashes([(t,) for t in toks], "xxhash64(a)", "a string")
        padded = [0] * (k - 1) + h + [0] * (k - 1)
        grams = [tuple(padded[i : i + k]) for i in range(len(h) + k - 1)] if h else []
        km = [x >> 24 for x in hashes(grams, "xxhash64(a, b, c)", "a long, b long, c long")]
        seen, numbered = Counter(), []
        for x in km:
            numbered.append((x, seen[x]))
            seen[x] += 1
        g = hashes(numbered, "xxhash64(a, b)", "a long, b int")
        by = defaultdict(list)
        for at, x in enumerate(g):
            by[x & (bins - 1)].append(((x >> 5) & ((1 << 33) - 1), at & mask))
        want = []
        for b in sorted(by):
            two = sorted(sorted(by[b])[:2], key=lambda t: t[1])
            [v] = hashes([tuple(b << 33 | t[0] for t in two)], "xxhash64(a, b)" if len(two) == 2 else "xxhash64(a)", "a long, b long" if len(two) == 2 else "a long")
            want.append((b << 32) + (v & ((1 << 32) - 1)))
        assert p == want


def test_fingerprint_feels_order_and_edits(spark):
    rng = random.Random(2)
    w = prose(rng, 400).split()
    a, edited, moved, other = " ".join(w), " ".join(w[:380]), " ".join(w[200:] + w[:200]), prose(rng, 400)
    p = prints(spark, [a, a, edited, moved, other])
    assert p[0] == p[1]
    df = spark.createDataFrame([(p[0], q) for q in p[1:]], "a array<long>, b array<long>")
    like = [r[0] for r in df.select(fingerprint.likeness(F.col("a"), F.col("b"))).collect()]
    assert like[0] == 1 and like[1] > like[2] > like[3] and like[3] < 0.1


@pytest.mark.parametrize("n_parts", [1, 7, 40])
def test_next_document_wraps_around(spark, n_parts):
    """With ids beyond 2**53 that differ by one, repeated and missing ones."""
    rng = random.Random(3)
    ids = rng.sample(range(1000), 30) + [5000] * 9 + [2**62 + k for k in range(25)] + [None] * 20 + [-(2**63), 2**63 - 1]
    df = spark.createDataFrame([(i, f"t{i}-{k}") for k, i in enumerate(ids)], "doc_id long, text string").repartition(3)
    t = {r.text: r.t for r in df.select("text", F.xxhash64("text").alias("t")).collect()}
    got = {(r.doc_id, r.text): r.next.text for r in fingerprint.following(fingerprint.with_next(df, "doc_id", "text", n_parts), "text").collect()}
    order = sorted(((i is None, i or 0, t[f"t{i}-{k}"], f"t{i}-{k}") for k, i in enumerate(ids)))
    assert got == {(None if a[0] else a[1], a[3]): b[3] for a, b in zip(order, order[1:] + order[:1], strict=True)}


@pytest.mark.parametrize("which", ["all", "one", "none", "nulls"])
def test_fingerprint_query_equals_brute_force(spark, tmp_path, which):
    rng = random.Random(11)
    rows = [(k * 3, prose(rng, rng.randint(1, 40))) for k in range(25)]
    rows += [(2**60 + k, "x" * (60 + k) + " end") for k in range(8)] + [(7, " ".join("abcdefgh"[:n])) for n in range(8)]
    rows += [(None, "no id"), (None, None), (900, None), (901, ""), (902, "   "), (903, "ok"), (904, rows[0][1]), (905, "日本語のテキスト" * 12), (904, rows[0][1]), (906, "a😀b" * 30), (907, "w " * 3000)]
    rows = {"all": rows, "one": [(5, "a b c d e f g h")], "none": [], "nulls": [(None, f"t {k}") for k in range(20)] + rows[:20]}[which]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("Lang", F.lit(1)).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = fingerprint.op10_fingerprint(spark, str(tmp_path)).collect()
    texts = [(i, t or "") for i, t in rows]
    t = {r.x: r.t for r in spark.createDataFrame([(x,) for x in {x for _, x in texts}] or [("",)], "x string").select("x", F.xxhash64("x").alias("t")).collect()}
    order = sorted((i is None, i or 0, t[x], x) for i, x in texts)
    want = []
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        q = len(a[3]) // 4
        want.append((None if a[0] else a[1], a[3], a[3][: len(a[3]) - q] + b[3][:q], b[3]))
    p = prints(spark, [x for w in want for x in w[1:]]) if want else []
    text = lambda p: "".join(f"{x:010x}" for x in p)

    def like(a, b):
        bins = {x >> 32 for x in a} | {x >> 32 for x in b}
        return len(set(a) & set(b)) / len(bins) if bins else 1.0

    want = [(i, len(x), hashlib.sha256(e.encode()).hexdigest(), text(p[3 * k]), text(p[3 * k + 1]), like(p[3 * k], p[3 * k + 1]), like(p[3 * k], p[3 * k + 2])) for k, (i, x, e, _) in enumerate(want)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_short_and_unspaced_texts_stay_like_their_edits(spark):
    """A text of 68 characters that an edit brings under 64, texts of few words, and one without spaces."""
    for t in ("the quick brown fox jumps over the lazy dog and runs far away home..", "日本語のテキストは空白がありません。" * 8):
        p = prints(spark, [t, t[: len(t) - len(t) // 4] + "ok"])
        df = spark.createDataFrame([(p[0], p[1])], "a array<long>, b array<long>")
        assert df.select(fingerprint.likeness(F.col("a"), F.col("b"))).first()[0] > 0.2


# ---------------------------------------------------------------- language
def test_language_filters(spark):
    rng = random.Random(4)
    letters = {"en": "etaoinshr", "fr": "éàucqvejl", "de": "ßüöäwkzgn"}
    rows = [(i, prose(rng, 40, letters[k]), k) for i, k in enumerate(list(letters) * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    f = langid.learn(df.where("doc_id < 90"))
    test = df.where("doc_id >= 90").select("doc_id", "text").union(spark.createDataFrame([(900, None), (901, ""), (902, "12 34 !"), (903, "É")], "doc_id long, text string"))
    got = {r.doc_id: r for r in langid.identify(test.toDF("doc_id", "text").withColumn("Lang", F.lit("xx")), f).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows if i >= 90)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    g = np.unique(langid.grams(*utf8(pa.array(["ßüöß wkzg"])))[0])
    assert len(f.containing(g)) == 1
    kept = langid.accepted(test.withColumn("extra", F.lit(7)), f)
    assert kept.columns == ["doc_id", "text", "extra"] and {900, 901, 902}.isdisjoint(r.doc_id for r in kept.collect())
    assert kept.where("doc_id < 900").count() == 30


def test_predictions_equal_those_of_plain_sets(spark):
    """The query against counts of n-grams in sets, without any filter: only false positives may differ, and none here."""
    rng = random.Random(14)
    letters = {"en": "etaoinshr", "fr": "éàucqvejl", "de": "ßüöäwkzgn"}
    rows = [(i, prose(rng, 30, letters[k]), k) for i, k in enumerate(list(letters) * 30)] + [(500, None, "en"), (501, "", None), (502, "étaoins", "fr"), (None, "etao inshr", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = [(t, k) for i, t, k in rows if t is not None and k is not None and zlib.crc32(str(i).encode()) % 4 != 2 and i is not None]
    counts = {k: Counter() for k in letters}
    fours = lambda t: [x[i : i + 4] for x in [b" " + bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in t.lower().encode()) + b" "] for i in range(len(x) - 3)]
    for t, k in train:
        counts[k].update(fours(t))
    rate = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in counts.items()}
    best = {g: max(r.get(g, 0) for r in rate.values()) for c in counts.values() for g in c}
    sets = {k: {g for g, x in r.items() if x >= 0.3 * best[g]} for k, r in rate.items()}
    got = langid.identify(df, langid.learn(df.where("doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 4 != 2"))).collect()
    for r, (_, t, _) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(rows, key=lambda r: (r[0] is None, r[0])), strict=True):
        n = {k: sum(g in s for g in fours(t or "")) for k, s in sets.items()}
        if not re.search(r"[^\W\d_]", t or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
        else:
            assert r.lang_pred == max(sorted(n), key=n.get) and abs(r.score - max(n.values()) / max(1, sum(n.values()))) < 0.02


def test_bloom_slices_have_no_false_negatives():
    rng = np.random.default_rng(0)
    sets = {f"l{k:02}": rng.integers(0, 1 << 32, 500).astype(np.uint32) for k in range(70)}  # more than 64 languages
    f = langid.Filters.build(sets, 1 << 14)
    for k, name in enumerate(f.languages):
        masks = f.containing(sets[name])
        assert ((masks[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).all()


def test_language_without_training(nothing, docs):
    f = langid.learn(nothing)
    assert {r.lang_pred for r in langid.identify(docs, f).collect()} == {"und"}
    assert langid.identify(nothing, f).count() == 0


# ---------------------------------------------------------------- toxicity
def test_toxicity_learns_and_generalises(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        w = prose(rng, 60).split()
        bad = i % 4 == 0
        if bad:
            w[rng.randrange(60)] = rng.choice(["vileword", "nastyterm"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    m = toxicity.learn(toxicity.sample(d, spark.createDataFrame([*labels[:400], (5, None), (None, 1), (0, 0)], "doc_id long, toxic int")))
    assert 0 < len(m[0]) < 1000
    extra = spark.createDataFrame([(1000, None), (1001, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.scored(d.union(extra).withColumn("TEXT2", F.lit("x")), m).collect()}
    assert sum((got[i] >= 0.7) == (i % 4 == 0) for i in range(400, 600)) >= 194
    assert got[1000] == got[1001] and 0 <= got[1000] < 0.5


def test_toxicity_without_labels(docs, spark, nothing):
    m = toxicity.learn(toxicity.sample(docs, spark.createDataFrame([], "doc_id long, toxic int")))
    assert {r.score for r in toxicity.scored(docs, m).collect()} == {0.5} and toxicity.scored(nothing, m).count() == 0


def test_ftrl_equals_the_update_rule():
    """Against a sequential version over dictionaries."""
    rng = np.random.default_rng(7)
    rows = [np.unique(rng.integers(0, 30, 6)) for _ in range(120)]
    y = np.array([float((0 in r) or k % 9 == 0) for k, r in enumerate(rows)])
    z, n = defaultdict(float), defaultdict(float)
    heavy = (y == 0).sum() / y.sum()

    def weight(i, l1):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((1 + n[i] ** 0.5) / 0.5 + 0.1)

    for _ in range(3):
        for r, t in zip(rows, y, strict=True):
            places = [(i, 0.7) for i in r.tolist()] + [(30, 0.0)]
            ws = [weight(i, p) for i, p in places]
            g = (1 / (1 + np.exp(-sum(ws))) - t) * (heavy if t else 1)
            for (i, _), w in zip(places, ws, strict=True):
                s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.5
                z[i] += g - s * w
                n[i] += g * g
    w, b = toxicity.ftrl(rows, y, 30, passes=3, alpha=0.5, l1=0.7, l2=0.1, balance=1.0)
    assert np.allclose(w, [weight(i, 0.7) for i in range(30)]) and np.isclose(b, weight(30, 0.0))


def test_ftrl_is_sparse():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(1, 200, 20)) for _ in range(300)]
    y = np.array([k % 2 for k in range(300)])
    rows = [np.append(0, r) if t else r for r, t in zip(rows, y, strict=True)]
    w, _ = toxicity.ftrl(rows, y, 200, l1=4.0)
    assert w[0] > 1 and (w[1:] == 0).mean() > 0.8


# ---------------------------------------------------------------- top-k
def brute_top(rows, k, every):
    v = {i: [int(np.floor(256 * x)) for x in e] for i, e in rows if e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e)}
    out = []
    for i in sorted(v):
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v[i], e, strict=False)), j) for j, e in v.items() if j != i)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize("n", [3, 300])
def test_topk_equals_brute_force(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rng.normal(size=12) * (1 + i % 5)]) for i in range(n)]
    rows += [(n + k, list(rows[0][1])) for k in range(8)]  # ties
    rows += [(n + 10, None), (n + 11, [float("nan")] * 12), (n + 12, [None] * 12), (n + 13, []), (n + 14, [1e5, -1e5] + [0.0] * 10), (n + 15, [2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("Embedding2", F.lit(1)).toDF("vec_id", "embedding", "VEC_ID")
    v = topk.whole(df, "vec_id", "embedding")
    got = topk.top_k(v.where("id % 10 = 0"), v, 5, block=40, per_query_block=7)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute_top(rows, 5, 10)


def test_repeated_ids_are_rows_of_their_own(spark):
    """Two queries of one id, and candidates that share an id with others or with a query."""
    rng = np.random.default_rng(5)
    ids = [50, 50, 100, *range(1, 40), *range(1, 40), 7, 7]
    vectors = [[int(x) for x in rng.integers(-50, 50, 6)] for _ in ids]
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in zip(ids, vectors, strict=True)], "id long, v array<double>")
    got = topk.top_k(df.where("id % 50 = 0"), df, 5, block=16, per_query_block=2).collect()
    want = []
    for i, q in zip(ids, vectors, strict=True):
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in zip(ids, vectors, strict=True) if j != i)
            want += [(i, k + 1, j, -x) for k, (x, j) in enumerate(scores[:5])]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_topk_prunes():
    rng = np.random.default_rng(1)
    c = np.floor(rng.normal(size=(500, 32)) * np.linspace(80, 1, 32) * np.linspace(3, 0.1, 500)[:, None])
    q = c[:5]
    exact = np.sort(c @ q[0])[::-1]
    basis = np.linalg.svd(c, full_matrices=False)[2].T
    stats = {}
    out = topk.search_block(np.arange(-5, 0), q, np.array([np.sort(c @ x)[-5] for x in q]), np.arange(500), c, basis, 5, 8, stats)
    assert [s for i, _, s in out if i == 0][:5] == exact[:5].astype(int).tolist() and stats["scored"] < 500


def test_topk_of_nothing(spark):
    v = topk.whole(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert topk.top_k(v, v).count() == 0


# ---------------------------------------------------------------- near duplicates
def brute_components(rows):
    sets = []
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    par = list(range(len(sets)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                par[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


def test_jaccard_equals_brute_force(corpus, clashing):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar(clashing).collect())
    assert got == brute_components([(i, t) for i, t, *_ in corpus])


@pytest.mark.parametrize("seed", range(2))
def test_jaccard_at_the_threshold(spark, seed):
    """Chains of edits whose ends are far apart, and pairs just above and below the threshold."""
    rng = random.Random(seed)
    rows, w = [], prose(rng, 120).split()
    for i in range(60):
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"q{rng.randrange(5)}"
        v = list(w)
        for _ in range(rng.randint(0, 2)):
            v[rng.randrange(len(v))] = f"u{i}"
        rows.append((1000 - i, " ".join(v)))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_components(rows)


def test_one_of_each_group_stays(corpus, docs):
    kept = [r.doc_id for r in jaccard.one_of_each(docs).collect()]
    want = {i for i, _, c in brute_components([(i, t) for i, t, *_ in corpus]) if i == c}  # a repeated row stays once
    assert sorted(kept) == sorted(want)


def test_rows_that_share_or_lack_a_doc_id(spark):
    rng = random.Random(12)
    a, b, c, d = (prose(rng, 40) for _ in range(4))
    rows = [(1, a), (1, a + " more"), (1, b), (None, b + " x"), (None, c), (None, c), (None, c + " y"), (2**62, d), (None, None), (None, " "), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar(df).collect())
    assert got == Counter([(1, 36, 1), (1, 37, 1), (1, 36, 1), (None, 37, 1), (None, 36, None), (None, 36, None), (None, 37, None), (2**62, 36, 2**62), (None, 0, None), (None, 0, None), (7, 0, 7)])
    kept = Counter((r.doc_id, r.text) for r in jaccard.one_of_each(df).collect())
    one_of = [[(1, a), (1, a + " more")], [(1, b)], [(None, c), (None, c + " y")], [(2**62, d)], [(None, None)], [(None, " ")], [(7, None)]]
    assert sum(kept.values()) == len(one_of) and all(sum(kept[x] for x in group) == 1 for group in one_of)


def test_overlaps_are_counted_by_ranges_of_the_order(spark):
    """Ranges follow frequency, then hash; every n-gram is in one, all of about equal size; a missing range shows."""
    rng = np.random.default_rng(2)
    sets = []
    for i in range(60):
        h = np.unique(rng.integers(-(2**63), 2**63 - 1, 40))
        n = np.sort(rng.choice([2, 2, 2, 3, 5, 9], len(h))).astype(int)
        sets.append((i, len(h), h.tolist(), n.tolist()))
    sets += [(100 + i, n, h, k) for i, n, h, k in sets[:20]]
    df = spark.createDataFrame(sets, "id long, n long, hashes array<long>, counts array<int>")
    cuts = jaccard.order_ranges(df, 4)
    cut = jaccard.cut_sets(df, cuts)
    order = {h: (n, h % 2**64) for _, _, hs, ns in sets for h, n in zip(hs, ns, strict=True)}
    parts = defaultdict(list)
    for r in cut.collect():
        parts[r.f] += [order[h] for h in r.part]
    assert sorted(parts) == [0, 1, 2, 3] and sum(map(len, parts.values())) == sum(s[1] for s in sets)
    assert all(max(parts[f]) < min(parts[f + 1]) for f in range(3)) and min(map(len, parts.values())) > 0.03 * sum(map(len, parts.values()))
    pairs = spark.createDataFrame([(i, 100 + i) for i in range(20)] + [(0, 1)], "a long, b long")
    assert {(r.a, r.overlap) for r in jaccard.overlaps(pairs, cut).collect()} >= {(i, sets[i][1]) for i in range(20)}
    assert all(r.overlap < sets[r.a][1] for r in jaccard.overlaps(pairs, cut.where("f != 2")).collect())


def test_jaccard_of_nothing(nothing):
    assert jaccard.similar(nothing).count() == 0


# ---------------------------------------------------------------- repeated passages
def brute_removals(rows, length=100):
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - length + 1):
            s = b[a : a + length]
            if s in seen:
                gone[a : a + length] = b"\1" * length
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_dedup_equals_brute_force(corpus, clashing, docs):
    rows = sorted({(i, t or "") for i, t, *_ in corpus})
    got = suffixes.removals(docs.dropDuplicates(["doc_id", "text"])).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_removals(rows)
    assert suffixes.removals(clashing).count() == len(corpus)  # two rows are equal


def test_suffix_dedup_without_doc_ids(spark):
    rng = random.Random(4)
    t = prose(rng, 80)
    rows = [(None, t), (2**63 - 1, t + " end"), (3, t), (None, None)]
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suffixes.removals(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    n = len(t)
    assert got == {(None, n): n, (2**63 - 1, n + 4): n, (3, n): 0, (None, 0): 0}


def test_segments_of_equal_sums_are_told_apart_by_bytes(spark, monkeypatch):
    """With sums that say nothing, the result is the same."""
    rng = random.Random(6)
    piece = prose(rng, 70)
    rows = [(k, piece[rng.randint(0, 150) : rng.randint(200, 400)] + "xy" * rng.randint(0, 90)) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(suffixes, "odd", lambda seed, n: np.zeros(n, np.uint64))
    got = suffixes.removals(df).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_removals(rows)


@pytest.mark.parametrize("seed", range(3))
def test_suffix_dedup_on_periodic_and_overlapping_texts(spark, seed):
    rng = random.Random(seed)
    piece = prose(rng, 70)
    rows = [(k, "".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) + piece[rng.randint(0, 150) : rng.randint(200, 400)] + "xy" * rng.randint(0, 130) + "é" * rng.randint(0, 90)) for k in range(40)]
    got = suffixes.removals(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_removals(rows)


def test_columns_give_the_suffix_order():
    """Rows with text from begin to end: a string is marked if, and only if, a row of smaller rank has it there."""
    rng = np.random.default_rng(4)
    rows = rng.integers(97, 99, (60, 40)).astype(np.uint8)
    rows[30:] = rows[:30]
    rows[40:50, 35] = 97
    begin, end = rng.integers(0, 4, 60), rng.integers(36, 41, 60)
    for k in range(60):
        rows[k, : begin[k]] = 255
        rows[k, end[k] :] = 255
    rank = rng.permutation(60)
    first, last = suffixes.repeated(rows, rank, begin, end, 12)
    for k in range(60):
        hit = [j for j in range(begin[k], end[k] - 11) if any(rank[m] < rank[k] and begin[m] <= j and end[m] >= j + 12 and (rows[m, j : j + 12] == rows[k, j : j + 12]).all() for m in range(60))]
        assert (first[k], last[k]) == ((hit[0], hit[-1]) if hit else (-1, -1))


def test_texts_without_repeats_keep_their_columns(corpus, docs, nothing):
    out = suffixes.without_repeats(docs)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and len(rows) == len({i for i, *_ in corpus})
    assert rows[400].text is None and rows[401].text == "" and rows[101].text == "" and rows[0].text == next(t for i, t, *_ in corpus if i == 0)
    assert all(r.n_chars == len(r.text) for r in rows.values() if r.text is not None)
    assert suffixes.without_repeats(nothing).count() == 0 and suffixes.removals(nothing).count() == 0


def test_fragments_of_anchors_are_even():
    """Anchors are local minima of hashes; fragments are ranges of what anchors() returns."""
    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, 3_000_000).astype(np.uint8)
    _, h = suffixes.anchors(data, np.array([0, len(data)]))
    n = np.bincount(suffixes._fragments(h, 100), minlength=100)
    assert n.max() < 4 * n.mean() and n.min() > 0


def test_toxicity_query_learns_from_the_other_rows_only(spark, tmp_path):
    """op8 on a small table: its scores are those of a sequential FTRL fit to the rows that aren't held out."""
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(240):
        w = prose(rng, 30).split()
        if i % 3 == 0:
            w[rng.randrange(30)] = "vileword"
        rows.append((i, " ".join(w), "en", "s", 0))
        marks.append((i, 1, int(i % 3 == 0)))
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(240)]
    wrong = [(i, q, 1 - t) if held[i] else (i, q, t) for i, q, t in marks]  # labels of held-out rows are never read
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(wrong, "doc_id long, quality int, toxic int").repartition(3).write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.op8_toxicity(spark, str(tmp_path)).collect()}
    assert [got[i].held_out for i in range(240)] == held
    known = spark.createDataFrame([r[:2] for r, h in zip(rows, held, strict=True) if not h], "doc_id long, text string")
    ordered = known.orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    ids = ordered.column("doc_id").to_pylist()
    places = lambda t: np.unique(toxicity.features(*utf8(pa.array([t])))[0])
    texts = dict((r[0], r[1]) for r in rows)
    x, y = [places(texts[i]) for i in ids], np.array([float(i % 3 == 0) for i in ids])
    seen = Counter(p for r in x for p in r.tolist())
    best = None
    for share in toxicity.L1_SHARES:
        z, n, heavy = defaultdict(float), defaultdict(float), (y == 0).sum() / y.sum()
        weight = lambda i, l1: 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / (1 + n[i] ** 0.5)  # noqa: B023, E731
        for _ in range(toxicity.PASSES):
            for r, t in zip(x, y, strict=True):
                at = [(p, share * heavy) for p in r.tolist() if seen[p] >= toxicity.RARE] + [(-1, 0.0)]
                ws = [weight(p, q) for p, q in at]
                g = (1 / (1 + np.exp(-np.clip(sum(ws), -35, 35))) - t) * (heavy if t else 1)
                for (p, _), w in zip(at, ws, strict=True):
                    s = (n[p] + g * g) ** 0.5 - n[p] ** 0.5
                    z[p] += g - s * w
                    n[p] += g * g
        want = [1 / (1 + np.exp(-(weight(-1, 0.0) + sum(weight(p, share * heavy) for p in places(texts[i]).tolist() if seen[p] >= toxicity.RARE)))) for i in range(240)]
        off = max(abs(want[i] - got[i].score) for i in range(240))
        best = off if best is None else min(best, off)
    assert best < 1e-5
    assert sum(got[i].predicted == (i % 3 == 0) for i in range(240) if held[i]) >= 0.95 * sum(held)

"""The ten operators on small inputs: brute force, round trips, odd rows, empty tables."""

import collections
import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vidmart.llm import bpe, chat, knn, lines, neardup, packing, quality, recompress, suffix, toxicity
from vidmart.llm.common import keyed

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "a b c " * 40), (6, "a b c " * 40), (None, "stray text here"), (7, "é" * 300), (8, "x" * 500)]


def long_text(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "été", "Ω", "x1", "end."]) + str(rng.randint(0, 50)) for _ in range(n))


def docs(seed=5):
    """Texts with shared passages, near copies, exact copies and odd rows."""
    rng = random.Random(seed)
    passage = long_text(rng, 60)
    out = []
    for i in range(40):
        t = long_text(rng, rng.randint(20, 150))
        if i % 4 == 0:
            t = f"{t}\n{passage}\n{t[:30]}"
        out.append((i + 10, t))
    for i in range(12):
        words = out[i % 3][1].split(" ")
        for _ in range(i):
            words[rng.randrange(len(words))] = f"new{i}"
        out.append((100 + i, " ".join(words)))
    return out + ODD


# ---- 1, 9

@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, struct.pack(f"<{len(ids)}I", *ids)


def test_tree_concatenation_is_exact(library):
    rng, own = random.Random(1), bpe.WordBpe(piece=16)
    for k in range(400):
        s = "".join(rng.choice("abcdetheinÉèß!?") for _ in range(rng.randint(20, 400))) if k % 2 else rng.choice("ah!é") * rng.randint(20, 500)
        assert own.encode(s) == ids_of(library, s)[1]
    for s in ("a\x1cb \x1d!", "İ ΣΑΣ", "it's <|endoftext|>x<|startoftext|> <|ENDOFTEXT|>", "é ́   b　c", "12٣ ½", "\x00 \x7f", "a\x85b"):
        assert own.encode(s) == ids_of(library, s)[1]


def test_bpe_digests_and_parallel_parts(spark, make, library):
    rows = [*ODD, (20, long_text(random.Random(2), 900) + "<|endoftext|>" + "qwé!" * 900 + "ab" * 3000 + " end")]
    want = collections.Counter()
    for i, t in rows:
        ids, raw = ids_of(library, t)
        want[i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    for long_chars in (1 << 16, 100):
        got = bpe.encode_text(make(rows), long_chars=long_chars, part_chars=64)
        assert collections.Counter(map(tuple, got.collect())) == want
    assert bpe.encode_text(make([])).count() == 0


def test_packing(spark, make, library):
    rows = [*ODD, (30, long_text(random.Random(3), 3000))]
    got = packing.pack_documents(make(rows), capacity=512).collect()
    assert sum(r["length"] for r in got) == sum(len(ids_of(library, t)[0]) + 1 for _, t in rows)
    for r in got:
        if r["doc_id"] == 30:
            part = (ids_of(library, rows[-1][1])[0] + [1])[r["start"]:r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part)) and r["start"] == 512 * r["piece"]
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for off, n in sorted(b):
            assert off == at
            at += n
        assert at <= 512
    assert packing.pack_documents(make([])).count() == 0


def test_plans_use_every_piece_and_few_bins():
    rng = random.Random(4)
    for _ in range(60):
        counts = collections.Counter(rng.randint(1, 50) for _ in range(rng.randint(1, 80)))
        plan, used = packing.plan_bins(dict(counts), 50), collections.Counter()
        for pattern, times in plan:
            assert sum(x * n for x, n in pattern.items()) <= 50
            for x, n in pattern.items():
                used[x] += n * times
        assert used == counts
        assert sum(t for _, t in plan) <= -(-sum(x * n for x, n in counts.items()) // 50) + 3 + sum(n for x, n in counts.items() if x > 25) // 2


# ---- 2

def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6)], "e") for i in range(330)]
    rows += [(400, None, "e"), (500, [1.0, None, 0.0, 0.0, 0.0, 0.0], "e"), (600, [float("nan")] * 6, "e"), (700, [0.0] * 6, "e"), (31, rows[30][1], "e"), (900, rows[0][1], "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, d string")
    data = knn.scaled(df)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in knn.top_k(data.where("vec_id % 100 = 0"), data).collect()}
    held = [(r["vec_id"], r["v"]) for r in data.collect()]
    want = {}
    for q in sorted({i for i, _ in held if i % 100 == 0}):
        best = collections.defaultdict(lambda: -10**18)
        for qi, qv in held:
            if qi == q:
                for c, v in held:
                    if c != q:
                        best[c] = max(best[c], sum(a * b for a, b in zip(qv, v)))
        for rank, (c, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:10], 1):
            want[q, rank] = (c, s)
    assert got == want
    assert knn.top_k(data.where("false"), data).count() == 0 and knn.top_k(data, data.where("false")).count() == 0


@pytest.mark.parametrize("spread", [0.0, 0.01])
def test_top_k_with_one_vec_id_on_a_third_of_the_rows(spark, spread):
    rng = np.random.default_rng(1)
    hot = spark.range(400).orderBy(F.xxhash64("id"), "id").first()["id"]  # the pivot, and longer than the others
    vectors = [[float(x) * (4 if i == hot else 1) for x in rng.normal(size=5)] for i in range(400)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(hot, [x * (1 + spread * float(rng.normal())) for x in vectors[hot]]) for _ in range(200)]
    data = knn.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).localCheckpoint()
    held = [(r["vec_id"], r["v"]) for r in data.collect()]
    near = sorted((r for r in held if r[0] != hot), key=lambda r: -sum(a * b for a, b in zip(r[1], held[hot][1])))[:64]
    asked = data.where(F.col("vec_id").isin([i for i, _ in near]))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in knn.top_k(asked, data).collect()}
    want = {}
    for q, qv in near:
        best = {}
        for c, v in held:
            if c != q:
                best[c] = max(best.get(c, -10**18), sum(a * b for a, b in zip(qv, v)))
        for rank, (c, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:10], 1):
            want[q, rank] = (c, s)
    assert got == want


# ---- 3, 4

def labelled(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_quality_held_out(spark):
    d, labels = labelled(spark)
    got = quality.classify(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.95


def test_toxicity_held_out(spark):
    d, labels = labelled(spark)
    got = toxicity.classify(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.95 and sum(r["predicted"] for r in got if not r["toxic"]) <= 1


@pytest.mark.parametrize("op", [quality.classify, toxicity.classify])
def test_classifiers_take_odd_rows(spark, make, op):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 1), (99, 1, 1), (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    got = op(make(ODD), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert op(make([]), labels.where("false")).count() == 0


def test_block_max_neighbours_are_exact():
    rng = random.Random(6)
    vocabulary = toxicity.Vocabulary([f"t{i}" for i in range(12)])
    rows = [collections.Counter(rng.choices(range(12), k=rng.randint(1, 6))) for _ in range(300)]
    model = toxicity.Neighbours(vocabulary, np.linspace(1, 3, 12), list(range(300)), np.array([i % 2 for i in range(300)], float), rows, k=7)
    full = np.zeros((300, 12))
    for i, r in enumerate(rows):
        t, w = model.vector(r)
        full[i, t] = w
    for i in range(50):
        found, cosines = model.nearest(model.vector(rows[i]))
        s = np.round(full @ full[i], 12)
        assert found.tolist() == np.lexsort((np.arange(300), -s))[:7].tolist() and np.allclose(cosines, s[found])


def test_toxicity_by_words_of_few_examples(spark, make):
    """Words of two toxic examples are too rare to be chosen; a text that holds them is still found."""
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices([f"w{chr(97 + k)}" for k in range(26)], k=12))) for i in range(120)]
    labels = spark.createDataFrame([(i, 0) for i in range(120)] + [(i, 1) for i in range(200, 212)], "doc_id long, toxic int")
    rows += [(i, f"rarest scarcest {'abcdef'[j % 6] * 9}") for j, i in enumerate(range(200, 212))]
    asked = [(1000, "rarest scarcest abc"), (1001, "wa wb wc wd"), (1002, "?")]
    d = make(rows + asked)
    some = [r["doc_id"] for r in toxicity.training_rows(d, labels, "toxic", toxicity.FOLDS, toxicity.HELD_OUT, 1000).where("y = 1").orderBy("doc_id").collect()][:3]
    few = labels.where(F.col("toxic") == 0).unionByName(labels.where(F.col("doc_id").isin(some)))
    got = {r["doc_id"]: r for r in toxicity.classify(d.where(F.col("doc_id").isin(some) | ~F.col("doc_id").between(200, 299)), few).collect()}
    assert not toxicity.fit(d, few).vocabulary.terms
    assert got[1000]["score"] > 10 * got[1001]["score"] and {e["doc_id"] for e in got[1000]["evidence"]} == set(some)
    assert got[1002]["evidence"] == []


def test_whole_text_neighbours_are_exact():
    rng = random.Random(9)
    rows = [tuple(np.array(x) for x in zip(*sorted(collections.Counter(min(rng.randrange(40), rng.randrange(40)) for _ in range(9)).items()))) for _ in range(200)]
    whole = toxicity.WholeTexts([f"w{i}" for i in range(40)], np.linspace(1, 3, 40), rows)
    full = np.zeros((200, 40))
    for i, (t, w) in enumerate(whole.vectors):
        full[i, t] = w
    got = whole.cosines(whole.vectors[:50])
    for i in range(50):
        s = np.round(full @ full[i], 12)
        found, cosines = toxicity.best(got[i], 7)
        assert found.tolist() == np.lexsort((np.arange(200), -s))[:7].tolist() and np.allclose(cosines, s[found])


def test_copies_are_told_by_the_whole_text():
    rng = random.Random(10)
    texts = ["of the " + long_text(rng, 80) for _ in range(400)]
    assert len({toxicity.copy_key(t) for t in texts}) == 400 and toxicity.copy_key(texts[0].upper()) == toxicity.copy_key(texts[0])


# ---- 5

@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, make, size):
    rows = docs()
    sets = {}
    for i, t in rows:
        if i is not None:
            sets[i] = neardup.shingle_set(t or "", size)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = neardup.near_duplicates(make(rows), size=size).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"])
    assert neardup.near_duplicates(make([]), size=size).count() == 0


# ---- 6

def test_chat_round_trip(spark, make):
    rows = [(1, 0, "user", "hi \\ <|im_end|>"), (1, 1, "assistant", "a\\n<|<|im_start|>x"), (1, 1, "assistant", "a\\n<|<|im_start|>x"), (2, 5, None, None),
            (2, 3, "we\nird", "q\n"), (3, 0, "assistant", "")] + [(4, k, "user" if k % 2 else "assistant", f"t{k}") for k in range(70)]
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        g = got[c]
        assert (g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) == (
            len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_conversations(empty)).count() == 0


def test_reply_trees_rank_branches(spark):
    m = spark.createDataFrame([(1, None, 1.0), (2, 1, 5.0), (3, 1, 0.0), (4, 2, 0.0), (5, 3, 9.0), (6, 5, 9.0), (7, 77, None)], "node long, parent long, score double")
    got = collections.defaultdict(list)
    for r in chat.paths(m).collect():
        got[r["path"], r["rank"]].append((r["pos"], r["node"]))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {(6, 1): [1, 3, 5, 6], (4, 2): [1, 2, 4], (7, 1): [7]}
    assert {r["path"] for r in chat.paths(m, branches=1).collect()} == {6, 7}


# ---- 7, 10

def held(df):
    return keyed(df, suffix.order_of(F.col("doc_id")), F.col("doc_id").cast("long").alias("doc_id"), "text")


@pytest.mark.parametrize("width", [6, 35])
def test_repeated_word_windows(spark, make, width):
    rows = docs()
    words = [(t or "").encode().split() for _, t in rows]
    count = collections.Counter(tuple(w[s:s + width]) for w in words for s in range(len(w) - width + 1))
    want = collections.Counter()
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if count[tuple(w[s:s + width])] > 1:
                gone[s:s + width] = [True] * width
        want[i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()] += 1
    got = recompress.removed_words(held(make(rows)), recompress.digest, recompress.DIGEST, width)
    assert collections.Counter(map(tuple, got.collect())) == want
    assert recompress.removed_words(held(make([])), recompress.digest, recompress.DIGEST).count() == 0


@pytest.mark.parametrize("width", [40, 100])
def test_repeated_byte_strings(spark, make, width):
    rows = [r for r in docs() if r[0] not in (None, 4)]
    seen, want = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if b[s:s + width] in seen:
                gone[s:s + width] = b"\1" * width
            seen.add(b[s:s + width])
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        want[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    got = suffix.removed_bytes(held(make(rows)), suffix.digest, suffix.DIGEST, width, 16).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want
    assert suffix.removed_bytes(held(make([])), suffix.digest, suffix.DIGEST).count() == 0


def test_suffix_array():
    rng = random.Random(8)
    for _ in range(400):
        k, n = rng.choice([1, 2, 3, 9]), rng.randint(1, 50)
        s = [rng.randint(1, k) for _ in range(n)] + [0]
        assert suffix.suffix_array(np.array(s), k + 1).tolist() == sorted(range(n + 1), key=lambda i: s[i:])


def test_cleaned_texts_keep_columns_and_characters(spark, make):
    df = make(ODD)
    got = suffix.without_repeats(df)
    assert got.columns == df.columns and got.count() == len(ODD)
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts[1] is None and texts[2] == "" and set(texts[7]) == {"é"} and len(texts[7]) < 300


# ---- 8

def test_line_rules(spark, make):
    notice = "All rights reserved by nobody at all"
    rows = [(i, f"{long_text(random.Random(i), 30)}\n{notice}", "h") for i in range(40)] + [(50, notice + "\nbut one", "h"), (51, notice + " " + notice, None)]
    rows += [(i, t, "odd") for i, t in ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("host", F.lit(1)).withColumn("lines", F.lit(2))
    got = {(r["doc_id"], r["n_words"]): r for r in lines.line_rules(df).collect()}
    assert all(got[i, 37]["kept"] and got[i, 37]["n_lost_words"] == 7 for i in range(40))
    assert not got[50, 9]["kept"] and got[51, 14]["n_lost_words"] == 0
    assert got[5, 120]["n_repeat_words"] == 120 and got[5, 120]["base_failed"] and got[1, 0]["base_failed"]
    assert lines.line_rules(df.where("false")).count() == 0


def test_native_plan_has_no_python(spark):
    plan = lines.op8_line_rules(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def thue_morse(n, a, b):
    out = [a]
    while len(out) < n:
        out += [b if x == a else a for x in out]
    return out


def test_hashes_have_no_known_pairs():
    """Words that agree under every polynomial hash modulo 2**64, for strings of letters and of words."""
    from vidmart.llm import arrays
    for n in (128, 1024):
        raw = np.frombuffer("".join(thue_morse(n, "a", "b") + thue_morse(n, "b", "a")).encode(), np.uint8)
        for hashes in (arrays.byte_prefix(raw), arrays.prefix(raw.astype(np.uint64))):
            a, b = arrays.span(hashes, np.array([0, n]), np.array([n, 2 * n]))
            assert a != b
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    values[2000:2500] = values[100:600]
    hashes = arrays.prefix(values)
    lo = np.arange(100, 580)
    assert (arrays.span(hashes, lo, lo + 20) == arrays.span(hashes, lo + 1900, lo + 1920)).all()
    assert len(np.unique(arrays.span(hashes, lo, lo + 20))) == len(lo)


def test_near_duplicates_are_not_joined_by_a_weak_hash(spark, make):
    x, y = "".join(thue_morse(1024, "a", "b")), "".join(thue_morse(1024, "b", "a"))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(make([(1, x), (2, y), (3, x.upper())]), size=2).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_equal_sets_in_another_order_are_linked(spark, make):
    rows = [(1, "a b a c a b"), (2, "b a c a b a"), (3, "c a b a c a b"), (4, "a b a")]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(make(rows), size=2).collect()}
    sets = {i: neardup.shingle_set(t, 2) for i, t in rows}
    assert sets[1] == sets[2] == sets[3] != sets[4] and got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_word_windows_are_not_removed_by_a_weak_hash(spark, make):
    x, y = "".join(thue_morse(1024, "a", "b")), "".join(thue_morse(1024, "b", "a"))
    head = " ".join(f"w{i}" for i in range(34))
    docs = make([(1, f"{head} {x}"), (2, f"{head} {y}")])
    rows = docs.select(F.col("doc_id").alias("rid"), F.col("doc_id").alias("ord"), "doc_id", "text")
    got = recompress.removed_words(rows, recompress.digest, recompress.DIGEST).collect()
    assert [r["n_removed"] for r in got] == [0, 0]


def test_suffix_array_of_many_names():
    rng = np.random.default_rng(3)
    s = np.append(rng.integers(1, 258, 100_000), 0)
    s[50_000:80_000] = s[10_000:40_000]
    sa, raw = suffix.suffix_array(s, 258), (s + 0).astype(">u2").tobytes()
    assert len(np.unique(sa)) == len(s)
    assert all(raw[2 * a:2 * a + 400] <= raw[2 * b:2 * b + 400] for a, b in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True))
    names = rng.integers(0, 5000, 100_000)
    names[:30_000] = names[60_000:90_000]
    order, held = suffix.doubled(names, None), names.astype(">u4").tobytes()
    assert all(held[4 * a:4 * a + 400] <= held[4 * b:4 * b + 400] for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True))


def test_words_are_those_of_the_expression():
    """Texts are split at white space and ASCII marks; other marks, digits and case as the expression has it, one use as another."""
    marks = ["", " ", ".", "_", "7", "-", "\n", "\x1c", " ", "’", "١", "²", "́", "中", "Σ", "İ", "Été", "ab", "AB", "x²"]
    rng = random.Random(4)
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(40))) for _ in range(2000)]
    for x in texts:
        assert toxicity.words_of(x) == collections.Counter(toxicity.WORD.findall(x.lower()))


def test_neighbours_are_found_by_few_array_operations(monkeypatch):
    """The blocks of a text are scored together, not one after the other term by term; the cosines stay sums in the terms' order."""
    rng = random.Random(5)
    rows = [collections.Counter({rng.randrange(30): rng.randint(1, 3) for _ in range(8)}) for _ in range(4000)]
    vocabulary = toxicity.Vocabulary([f"t{i}" for i in range(30)])
    model = toxicity.Neighbours(vocabulary, np.linspace(1, 3, 30), list(range(4000)), np.array([i % 2 for i in range(4000)], float), rows, k=9)
    vectors = [model.vector(r) for r in rows[:60]]
    calls = []
    flatnonzero = np.flatnonzero
    monkeypatch.setattr(np, "flatnonzero", lambda x: calls.append(1) or flatnonzero(x))
    got = [model.nearest(v) for v in vectors]
    assert model.blocks == 63 and len(calls) <= 60 * 4
    for (t, w), (found, cosines) in zip(vectors, got, strict=True):
        s = np.zeros(4000)
        for i, x in zip(t.tolist(), w.tolist(), strict=True):
            mine = slice(model.start[i * model.blocks], model.start[(i + 1) * model.blocks])
            s[model.doc[mine]] += x * model.weight[mine]
        assert found.tolist() == np.lexsort((np.arange(4000), -np.round(s, 12)))[:9].tolist() and cosines.tobytes() == s[found].tobytes()

"""The stages take each other's output, keep the columns of documents, and do what their operators do."""

import collections
import itertools
import random
import re
import struct
import zlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from vidmart.llm import neardup, quality, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_chain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert len(P.STAGES) == 5
    good = P.good_quality(spark, docs, SF)
    scored = {r["doc_id"] for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == scored
    clean = P.not_toxic(spark, good, SF)
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in toxicity.classify(good, labels).where("predicted = 0").collect()}
    single = P.one_of_each(spark, clean, SF)
    assert {r["doc_id"] for r in single.collect()} == {r["doc_id"] for r in neardup.near_duplicates(clean, size=5).where("kept").collect()}
    cut = P.no_repeats(spark, single, SF)
    assert cut.columns == docs.columns and cut.count() == single.count() and cut.where("n_chars <> length(text)").count() == 0
    out = P.packed(spark, cut, SF)
    assert out.select("doc_id").distinct().count() == cut.count()


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


def brute_dedup(rows):
    """Rows that stay: of each component of 5-word sets at 0.8 the one with the smallest doc_id, null last."""
    def shingles(t):
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        groups[find(i)].append((doc_id is None, doc_id or 0, i))
    return [rows[min(g)[2]] for g in groups.values()]


def brute_cut(rows, width=100):
    """Texts without the bytes of strings that start earlier: at a smaller doc_id (null first) or before in the same row."""
    place = lambda doc_id: -(2**63) if doc_id is None else doc_id
    first = {}
    for doc_id, t in sorted(rows, key=lambda r: place(r[0])):
        for i in range(len(t or "") - width + 1):
            first.setdefault(t[i:i + width], place(doc_id))
    out = []
    for doc_id, t in rows:
        gone, seen = set(), set()
        for i in range(len(t or "") - width + 1):
            s = t[i:i + width]
            if first[s] < place(doc_id) or s in seen:
                gone.update(range(i, i + width))
            seen.add(s)
        out.append((doc_id, "".join(c for i, c in enumerate(t or "") if i not in gone)))
    return out


def test_run_against_plain_python(spark, tmp_path):
    """Without labels both classifiers keep every row; dedup, cutting and packing are done by hand."""
    rng = random.Random(8)
    words = lambda n: [rng.choice("abcdefghij") + str(rng.randint(0, 3000)) for _ in range(n)]
    base, passage = words(200), " ".join(words(40))
    near = base[:100] + ["other"] + base[101:]
    rows = [(5, " ".join(near)), (9, " ".join(base)), (2, " ".join(words(80)) + " " + passage), (7, passage + " " + " ".join(words(50)) + " " + passage),
            (4, " ".join(words(60))), (4, " ".join(words(60))), (4, "twice twice"), (4, "twice twice"), (1, None), (1, ""), (3, " \n"),
            (None, "without an id " + passage), (None, " ".join(base).upper()), (6, " ".join(words(20_000))), (8, "x" * 30_000)]
    docs = [(i, t, "en", "web", len(t) if t is not None else None) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = P.run(spark, str(tmp_path)).collect()

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for doc_id, t in brute_cut(brute_dedup(rows)):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            want[doc_id, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096

"""URL filters, filter audit and prefix trie against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vidmart.llm import audit, trie, urls
from vidmart.llm.slots import Slots



def clash(df):
    """The table with more columns, named as the operators' own."""
    return df.select("*", *(F.lit("x").alias(c) for c in ("key", "rid", "n", "mask", "host", "action", "d1", "depth", "layer", "first")))


# --- urls
def url_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), a == "block", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


URLS = [None, "", "no scheme", "http://", "http:///x", "HTTP://WWW.Example.COM/en/1", "http://example.com/en/1", "http://example.com", "http://example.com?x://y/en/",
        "https://a.b.c.net/es/q?u#f", "https://a.net/fr/#x", "https://anet/fr/", "ftp://x.org/en/", "http://www.example.com/en", "http://xwww.example.com/en/",
        "http://com/", "http://É.com/É", "http://" + "a." * 30_000 + "net/fr/" + "x/" * 30_000, "a://b://c.com/", "http://net/es/"]


def judged(spark, texts, rules, **kw):
    pages = clash(spark.createDataFrame([(i % 7 if i % 5 else None, u) for i, u in enumerate(texts)], "page_id long, url string"))
    listed = spark.createDataFrame(rules, "action string, host string, path string")
    return sorted((tuple(r) for r in urls.filter_urls(pages, listed, **kw).collect()), key=repr)


def expected(texts, rules):
    return sorted(((i % 7 if i % 5 else None, *url_verdict(u, rules)) for i, u in enumerate(texts)), key=repr)


def test_urls_and_odd_rows(spark):
    texts = URLS + URLS[5:9] * 3
    assert judged(spark, texts, urls.RULES) == expected(texts, urls.RULES)
    assert judged(spark, texts, urls.RULES, max_bytes=0) == expected(texts, urls.RULES)


@pytest.mark.parametrize("kw", [{}, {"first": (1, 1), "later": (1, 1)}, {"max_bytes": 0}])
def test_cascade_is_exact(spark, kw):
    rng = random.Random(3)
    host = lambda: ".".join(rng.choice("abcd") for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "/".join(rng.choice("xyz") for _ in range(rng.randint(0, 3)))
    rules = [(rng.choice(["allow", "block"]), host(), path()) for _ in range(150)]
    rules += [("block", *rules[0][1:]), ("allow", *rules[0][1:]), rules[1]]
    odd = [("block", "", "/"), ("drop", "a.b", "/"), ("block", "a", "x"), ("block", None, "/")]
    texts = [f"http://{host()}{path()}" for _ in range(1500)]
    assert judged(spark, texts, rules + odd, **kw) == expected(texts, rules)


def test_cascade_levels(spark):
    listed = spark.createDataFrame([(f"k{i}",) for i in range(300)], "key string")
    other = spark.createDataFrame([(f"x{i}",) for i in range(3000)], "key string")
    first = urls.bloom(listed, 300, 2, 1, 0)
    outside = other.where(first.passes(F.col("key")))
    levels = urls.cascade(listed, first, outside)
    assert len(levels) > 3 and outside.count() > 100
    both = listed.unionByName(other).select("key", urls.holds(levels, F.col("key")).alias("in"))
    assert {r["key"] for r in both.where("in").collect()} == {f"k{i}" for i in range(300)}


def test_no_rules_no_pages(spark):
    assert judged(spark, URLS, [("block", "", "")]) == expected(URLS, [])
    pages = spark.createDataFrame([], "page_id long, url string")
    listed = spark.createDataFrame(urls.RULES, "action string, host string, path string")
    assert urls.filter_urls(pages, listed).collect() == []


def test_urls_stay_in_the_jvm(spark):
    plan = urls.op13_urls(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Join", plan)


# --- audit
def audited(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    masks = []
    for i, t, lang in rows:
        t = t or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
        bad = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
               bool(re.search("[#$%&*|]", t)), i is not None and i > least[t]]
        marks = [x for x in labels if x[0] == i and i is not None]
        masks.append((lang or "", {c for c, x in zip("ABCDE", bad, strict=True) if x}, any(x[1] == 1 for x in marks), any(x[2] == 1 for x in marks)))
    out = []
    for part in {m[0] for m in masks}:
        own, lines, total = [m for m in masks if m[0] == part], [], Counter()
        for p in itertools.permutations("ABCDE"):
            stay = own
            for s, c in enumerate(p):
                gone = [m for m in stay if c in m[1]]
                fails = sum(c in m[1] for m in own)
                stay = [m for m in stay if c not in m[1]]
                total[c] += len(gone)
                lines.append((c, (part, "".join(p), s + 1, len(stay), len(gone), fails - len(gone), sum(m[1] == {c} for m in own),
                                  sum(m[2] for m in gone), sum(m[3] for m in gone))))
        out += [(*x, total[c]) for c, x in lines]
    return sorted(out)


def test_audit_and_odd_rows(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice(["a", "B", "cc", "D#", "été"]) + str(rng.randint(0, k)) for _ in range(n)) for n, k in ((250, 900), (250, 20), (30, 9), (400, 5000), (210, 800))]
    rows = [(i, rng.choice(base), rng.choice(["en", "fr", None, ""])) for i in range(60)]
    rows += [(3, base[0], "en"), (3, base[0], "en"), (4, base[3], "fr"), (None, base[1], "en"), (None, None, None), (99, None, "de"), (98, "", "de"), (97, " \t", "de"),
             (200, "Word " * 60_000, "de"), (201, "Word " * 60_000, "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(50)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (1000, 1, 1)]
    docs = clash(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    marks = clash(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = audit.interactions(audit.document_masks(docs, marks))
    assert sorted(map(tuple, got.collect())) == audited(rows, labels)


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(audit.document_masks(docs, marks)).collect() == []
    some = audit.interactions(audit.document_masks(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string"), marks))
    assert some.count() == 600 and some.agg(F.sum("removed")).first()[0] == 120


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5])
def test_intervals_cover_every_rank_once(k):
    orders = list(itertools.permutations(range(k)))
    seen = defaultdict(list)
    for mask, step, lo, hi in audit.intervals(k):
        seen[mask] += [(rank, step) for rank in range(lo, hi)]
    for mask in range(1, 1 << k):
        first = [(rank, 1 + min(p.index(i) for i in range(k) if mask >> i & 1)) for rank, p in enumerate(orders)]
        assert sorted(seen[mask]) == first


# --- trie
def trie_of(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = (turns.get(c - c % 5, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, x in built.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    out = []
    for node, m in members.items():
        below = [x for x in members if x[:len(node)] == node]
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(node))
        childless = sum(not any(len(y) == len(x) + 1 and y[:-1] == x for y in members) for x in below)
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), sum(len(x) == len(node) + 1 for x in below), childless,
                    sum((len(members[x]) - 1) * (len(x[-1][1].encode()) if x else 0) for x in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_rows(seed, convs, kinds):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(convs * 2), convs):
        for turn in range(rng.randint(1, 12)):
            rows.append((c, turn, rng.choice(["user", "bot"]) if turn else "user", rng.choice(kinds) if turn or c % 3 else "hello"))
    return rows


@pytest.mark.parametrize("piece", [2, 3, 1024])
def test_trie(spark, piece, monkeypatch):
    monkeypatch.setattr(trie, "SHARD_NODES", 40)
    monkeypatch.setattr(trie, "BLOCK_IDS", 8)
    rows = trie_rows(piece, 90, ["a", "b", "été", ""])
    copies = [(500 + c, t, "user", x) for c in range(30) for t, x in enumerate("abcdefghijk")]
    df = clash(spark.createDataFrame(rows + copies, "conv_id long, turn long, role string, text string"))
    assert sorted((tuple(r) for r in trie.prefix_trie(df, piece=piece).collect()), key=repr) == trie_of(rows + copies)


def test_trie_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", ""), (1, 0, "", None), (None, 1, "user", "lost"), (None, None, None, None), (5, 3, "ab", "c"), (6, 3, "a", "bc"),
            (7, 1, "user", "x" * 300_000), (7, 1, "user", "x" * 300_000), (8, 1, "user", "x" * 300_000), (9, None, "user", "é"), (10, 1, "user", "only")]
    rows += [(20, t, "user", f"t{t}") for t in range(400)] + [(25, t, "user", f"t{t}") for t in range(400)]
    df = clash(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted((tuple(r) for r in trie.prefix_trie(df, piece=2).collect()), key=repr) == trie_of(rows)
    assert trie.prefix_trie(df.where("false")).collect() == []
    single = df.where("conv_id = 10")
    assert len(trie.prefix_trie(single).collect()) == len(trie_of([(10, 1, "user", "only")]))


def test_slots():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 2**64, (20_000, 2), dtype=np.uint64)
    slots = Slots(keys)
    assert sorted(slots.lookup(keys)) == list(range(len(keys)))
    assert (slots.lookup(keys ^ np.uint64(1)) == -1).all()
    assert (Slots(keys[:0]).lookup(keys) == -1).all()
    with pytest.raises(ValueError):
        Slots(np.concatenate([keys[:2], keys[:2]]))


def test_add_up_long_chain():
    n = 3000
    own = np.random.default_rng(2).integers(0, 2**64, (n, 2), dtype=np.uint64)
    parent = np.concatenate([np.zeros((1, 2), np.uint64), own[:-1]])
    order = np.random.default_rng(3).permutation(n)
    sums = trie.add_up(np.arange(n)[order], own[order], parent[order], np.ones((n, 1), np.int64))
    assert (sums[:, 0] == n - order).all()

"""Document toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are lower-cased words of letters and, marked by a star, their first 4, 5 and 6
letters; "term@3" stands for texts that have the term three times or more (a cosine
does not tell one use from five). All terms of the examples that tell the classes apart are chosen
(chi-square over examples, copies of one text counted once: texts that agree in ``HASHES``
minhashes of their word pairs). Document frequencies are counted over every document; a
text is the unit vector of (1 + log tf) * idf.

The examples are held as an inverted index in blocks of ``BLOCK`` examples, with each
term's greatest weight in each block. A block is scored only while the bound made of
these weights can still reach the k best found, so the neighbours are exact. Each
neighbour votes with a weight that falls with its distance; the votes become a
probability through a curve fitted to the examples, each left out of its own vote.
The neighbours are the evidence.

A text without a chosen term is compared with every example on all words of the examples,
also exactly; the curve of these votes is fitted to the examples without a chosen term.

Bounds: at most ``MAX_EXAMPLES`` labelled rows (least hash of the doc_id first) and their
words reach the driver and the tasks; every document is counted and scored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterable
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vidmart.llm.common import documents, give_back, in_files, release, saved, slices
from vidmart.llm.quality import fit_curve, fold, labelled_texts, training_rows

MAX_EXAMPLES = 8_000
#: Examples for which a task of their own is worth it.
EXAMPLE_ROWS = 400
LEAST_EXAMPLES = 4
LEAST_CHI = 25.0
PREFIXES = (4, 5, 6)
LEVELS = (1, 2, 3, 5)
NEIGHBOURS = 15
BLOCK = 64
#: Blocks that are scored at once, before the bound is looked at again; twice as many each time.
BLOCKS = 8
#: Minhashes that copies of one text agree in: word pairs of which a share s is common to two texts agree with a chance of s**HASHES.
HASHES = 8
#: Words that more than one in so many examples hold are multiplied as a matrix; texts that are compared at a time.
COMMON, TEXTS = 16, 128
#: Bytes of text that are scored at a time, enough for some times TEXTS usual texts.
TEXT_BYTES = 1 << 20
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
EVIDENCE = T.StructType().add("doc_id", "long").add("cosine", "double").add("label", "integer")
WORD = re.compile(r"[^\W\d_]+")
#: ASCII characters that are no part of a word, white space aside.
BREAKS = [chr(i) for i in range(33, 127) if not chr(i).isalpha()]


def terms(text: str) -> set[str]:
    uses = Counter(WORD.findall(text.lower()))
    heads: Counter = Counter()
    for w, n in uses.items():
        for k in PREFIXES:
            if len(w) > k:
                heads[w[:k] + "*"] += n
    uses.update(heads)
    return {t if level == 1 else f"{t}@{level}" for t, n in uses.items() for level in LEVELS if n >= level}


_draw = np.random.default_rng(20240301).integers(1, 2**31 - 1, (2, HASHES, 1), dtype=np.uint64)


def copy_key(text: str) -> str:
    """Digest of the minhashes of a text's word pairs: copies and most near copies share it, other texts don't."""
    words = text.lower().split()
    pairs = {zlib.crc32(f"{a} {b}".encode()) for a, b in zip(words, words[1:], strict=False)}
    if not pairs:
        return hashlib.md5(" ".join(words).encode()).hexdigest()
    h = np.fromiter(pairs, np.uint64, len(pairs)) % np.uint64(2**31 - 1)
    return hashlib.md5(((_draw[0] * h + _draw[1]) % np.uint64(2**31 - 1)).min(1).tobytes()).hexdigest()


class Vocabulary:
    """Counts of the chosen terms in a text, by one pass of an automaton over it."""

    def __init__(self, chosen: list[str]):
        self.terms = chosen
        self.auto = None

    def __getstate__(self):
        return {"terms": self.terms, "auto": None}

    def counts(self, text: str) -> Counter:
        if not self.terms:
            return Counter()
        if self.auto is None:
            by: dict[str, dict[bool, list[tuple[int, int]]]] = {}
            for i, t in enumerate(self.terms):
                base, _, level = t.partition("@")
                by.setdefault(base.rstrip("*"), {}).setdefault(base.endswith("*"), []).append((i, int(level or 1)))
            self.auto = ahocorasick.Automaton()
            for word, uses in by.items():
                self.auto.add_word(word, (word, uses))
            self.auto.make_automaton()
        text = text.lower()
        seen: Counter = Counter()
        which = {}
        for end, (word, uses) in self.auto.iter(text):
            if end >= len(word) and letter(text[end - len(word)]):
                continue
            inside = end + 1 < len(text) and letter(text[end + 1])  # a prefix goes on, a word does not
            if inside in uses:
                seen[word, inside] += 1
                which[word, inside] = uses[inside]
        return Counter({i: n for key, n in seen.items() for i, level in which[key] if n >= level})


def words_of(text: str) -> Counter:
    """Uses of each word, as WORD finds them in the lower-cased text, in a part of its time: white space
    and ``BREAKS`` end a word, so the text is split there, and only pieces that hold other marks are searched."""
    text = text.lower()
    for c in BREAKS:
        text = text.replace(c, " ")
    uses = Counter(text.split())
    for piece in [x for x in uses if not x.isalpha()]:
        n = uses.pop(piece)
        for w in WORD.findall(piece):
            uses[w] += n
    return uses


class Lexicon:
    """Numbers of known words."""

    def __init__(self, words: pa.Array):
        self.at = {w: i for i, w in enumerate(words.to_pylist())}

    def uses(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the known words of a text, ascending, and how often each is used."""
        uses = words_of(text)
        t = np.fromiter(map(self.at.get, uses, repeat(-1)), np.int64, len(uses))
        n = np.fromiter(uses.values(), np.int64, len(uses))
        order = np.argsort(t)
        order = order[t[order] >= 0]
        return t[order], n[order]


def letter(c: str) -> bool:
    return WORD.match(c) is not None


def weights(t: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of n uses of the terms t."""
    return (1 + np.log(n)) * idf[t] if len(t) else np.zeros(0)


def unit(t: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and weights of the unit vector of n uses of the terms t."""
    w = weights(t, n, idf)
    norm = np.sqrt((w * w).sum())
    return (t, w / norm) if norm > 0 else (t[:0], w[:0])


def joined(lo: np.ndarray, hi: np.ndarray, *of: np.ndarray) -> list[np.ndarray]:
    """The slices lo to hi of each array, one slice after the other."""
    ends = list(zip(lo.tolist(), hi.tolist(), strict=True))
    return [np.concatenate([x[:0], *(x[a:b] for a, b in ends)]) for x in of]


class WholeTexts:
    """Examples as unit vectors of all their words; rows: the words' numbers and uses of each.

    Held, and sent to the tasks, as the uses by word; the words stay an Arrow array. Weights, and the words' places, take
    several times that room and are made where texts are first compared, which the driver seldom does."""

    def __init__(self, words: pa.Array | list[str], idf: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.words = words if isinstance(words, pa.Array) else pa.array(words, pa.string())
        self.idf, self.n = idf, len(rows)
        self.rows = rows  # for the fit; not sent to the tasks
        self.norm = np.array([np.sqrt((w * w).sum()) for w in (weights(t, n, idf) for t, n in rows)])
        term = np.concatenate([np.zeros(0, np.int32), *(t for t, _ in rows)])
        order = np.argsort(term, kind="stable")
        self.start = np.searchsorted(term, np.arange(len(self.words) + 1), sorter=order)
        self.doc = np.repeat(np.arange(self.n, dtype=np.int32), [len(t) for t, _ in rows])[order]
        uses = np.concatenate([np.zeros(0, np.int32), *(n for _, n in rows)])
        self.uses = uses.astype(np.min_scalar_type(uses.max(initial=0)))[order]
        self.lexicon = self.matrix = None

    def __getstate__(self):
        return self.__dict__ | dict.fromkeys(("rows", "lexicon", "matrix", "row", "rare"))

    @property
    def vectors(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [unit(t, n, self.idf) for t, n in self.rows]

    def weigh(self) -> None:
        """Weights of common words as a matrix (row: each word's, or -1), of the others by word (rare: documents, weights, starts)."""
        held = np.diff(self.start)
        term = np.repeat(np.arange(len(held), dtype=np.int32), held)
        weight = (1 + np.log(self.uses.astype(float))) * self.idf[term]
        weight /= np.where(self.norm > 0, self.norm, np.inf)[self.doc]
        common = np.flatnonzero(held > max(1, self.n // COMMON))
        self.row = np.full(len(held), -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), self.n))
        of = self.row[term]
        self.matrix[of[of >= 0], self.doc[of >= 0]] = weight[of >= 0]
        self.rare = self.doc[of < 0], weight[of < 0], np.cumsum([0, *np.where(self.row < 0, held, 0)])

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if self.lexicon is None:
            self.lexicon = Lexicon(self.words)
        return self.lexicon.uses(text)

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return unit(*self.counts(text), self.idf)

    def cosines(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Cosine of each vector with each example, to 12 digits."""
        if self.matrix is None:
            self.weigh()
        doc, weight, start = self.rare
        shared = np.zeros((len(vectors), len(self.matrix)))
        out = np.zeros((len(vectors), self.n))
        for i, (t, w) in enumerate(vectors):
            row = self.row[t]
            shared[i, row[row >= 0]] = w[row >= 0]
            t, w = t[row < 0], w[row < 0]
            docs, weights = joined(start[t], start[t + 1], doc, weight)
            out[i] = np.bincount(docs, weights * np.repeat(w, start[t + 1] - start[t]), minlength=self.n)
        out += shared @ self.matrix
        return np.round(out, 12, out=out)


def best(cosines: np.ndarray, k: int, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest cosines above 0 and their places; ties go to the earlier example."""
    at = np.flatnonzero(cosines > 0)
    at = at[at != leave]
    if len(at) > k:
        at = at[cosines[at] >= np.partition(cosines[at], len(at) - k)[len(at) - k]]
    at = at[np.lexsort((at, -cosines[at]))[:k]]
    return at, cosines[at]


class Neighbours:
    """Labelled unit vectors as block-max postings."""

    def __init__(self, vocabulary: Vocabulary, idf: np.ndarray, ids: list[int], labels: np.ndarray, rows: Iterable[Counter], k: int = NEIGHBOURS,
                 whole: WholeTexts | None = None):
        self.vocabulary, self.idf, self.k = vocabulary, idf, k
        self.base = float(labels.mean()) if len(labels) else 0.0
        vectors = [self.vector(r) for r in rows]
        some = [i for i, (t, _) in enumerate(vectors) if len(t)]
        silent = [i for i, (t, _) in enumerate(vectors) if not len(t)]
        # without any word of the examples a text is as likely as the examples without a chosen term are
        self.silent = float((labels[silent].sum() + self.base) / (len(silent) + 1))
        self.all_ids, self.all_labels = np.array(ids, np.int64), labels
        self.ids = np.array([ids[i] for i in some], np.int64)
        self.labels = labels[some] if some else np.zeros(0)
        n, m = len(some), len(vocabulary.terms)
        self.blocks = -(-n // BLOCK)
        term = np.concatenate([vectors[i][0] for i in some]) if some else np.zeros(0, np.int64)
        weight = np.concatenate([vectors[i][1] for i in some]) if some else np.zeros(0)
        doc = np.repeat(np.arange(n), [len(vectors[i][0]) for i in some]) if some else np.zeros(0, np.int64)
        order = np.lexsort((doc, term))
        self.doc, self.weight = doc[order], weight[order]
        slot = term[order] * max(1, self.blocks) + self.doc // BLOCK
        self.start = np.searchsorted(slot, np.arange(m * max(1, self.blocks) + 1))
        self.bound = np.zeros(m * max(1, self.blocks))
        np.maximum.at(self.bound, slot, self.weight)
        self.bound = self.bound.reshape(m, max(1, self.blocks))
        self.curve = None
        votes = np.array([self.vote(*self.nearest(vectors[i], leave=j)) for j, i in enumerate(some)])
        if len(votes) and 0 < self.labels.mean() < 1:
            self.curve = fit_curve(votes - 0.5, self.labels)
        self.whole, self.whole_curve = whole, None
        if whole is not None and len(silent) and 0 < labels[silent].mean() < 1:
            near = [(best(c, k, leave=i), i) for lo in range(0, len(silent), TEXTS) for i, c in
                    zip(silent[lo:lo + TEXTS], whole.cosines([unit(*whole.rows[i], whole.idf) for i in silent[lo:lo + TEXTS]]), strict=True)]
            votes = np.array([self.vote(*x, labels) for x, _ in near if len(x[0])])
            if len(votes):
                self.whole_curve = fit_curve(votes - 0.5, labels[[i for x, i in near if len(x[0])]])

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        t = np.array(sorted(counts), np.int64)
        return unit(t, np.array([counts[i] for i in t.tolist()]), self.idf)

    def nearest(self, vector: tuple[np.ndarray, np.ndarray], leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples and their cosines; ties go to the earlier example."""
        t, w = vector
        if not len(t) or not self.blocks:
            return np.zeros(0, np.int64), np.zeros(0)
        reach = w @ self.bound[t]
        found, cosines, least = [], [], 0.0
        best = np.zeros(0)
        rest = np.argsort(-reach, kind="stable")
        rest, count = rest[reach[rest] > 0], BLOCKS
        while len(rest):
            part = rest[:count]
            part = part[reach[part] >= least - 1e-12]
            if not len(part):
                break
            rest, count = rest[count:], 2 * count
            slot = (t[:, None] * self.blocks + part).ravel()  # a term's blocks together: sums are made in the terms' order
            lo, hi = self.start[slot], self.start[slot + 1]
            docs, weights = joined(lo[hi > lo], hi[hi > lo], self.doc, self.weight)
            score = np.bincount(docs, np.repeat(np.repeat(w, len(part)), hi - lo) * weights)
            at = np.flatnonzero(score)
            at = at[at != leave]
            found.append(at)
            cosines.append(score[at])
            best = np.concatenate([best, score[at]])
            if len(best) >= self.k:
                best = np.partition(best, len(best) - self.k)[-self.k:]
                least = best[0]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        found, cosines = np.concatenate(found), np.concatenate(cosines)
        order = np.lexsort((found, -np.round(cosines, 12)))[:self.k]
        return found[order], cosines[order]

    def vote(self, found: np.ndarray, cosines: np.ndarray, labels: np.ndarray | None = None) -> float:
        """Share of label 1 among the neighbours, each weighted by closeness."""
        w = cosines / (1.05 - np.minimum(cosines, 1))
        return float(((w * (self.labels if labels is None else labels)[found]).sum() + 0.1 * self.base) / (w.sum() + 0.1))

    def scores(self, texts: list[str]) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
        """Score of each text, and its neighbours' doc_ids, cosines and labels."""
        out, rest = [], []
        for i, text in enumerate(texts):
            found, cosines = self.nearest(self.vector(self.vocabulary.counts(text)))
            if len(found):
                out.append((curved(self.curve, self.vote(found, cosines)), self.ids[found], cosines, self.labels[found]))
            else:
                rest.append(i)
                out.append((self.silent, found, cosines, cosines))
        for lo in range(0, len(rest) if self.whole is not None else 0, TEXTS):
            part = rest[lo:lo + TEXTS]
            for i, c in zip(part, self.whole.cosines([self.whole.vector(texts[i]) for i in part]), strict=True):
                found, cosines = best(c, self.k)
                if len(found):
                    v = self.vote(found, cosines, self.all_labels)
                    out[i] = (curved(self.whole_curve, v), self.all_ids[found], cosines, self.all_labels[found])
        return out


def curved(curve: tuple[float, float] | None, vote: float) -> float:
    return vote if curve is None else float(1 / (1 + np.exp(-np.clip(curve[0] * (vote - 0.5) + curve[1], -40, 40))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = MAX_EXAMPLES) -> Neighbours:
    """Build the index from a bounded set of labelled documents, with frequencies of all documents."""
    chosen = training_rows(docs, labels, label, FOLDS, HELD_OUT, limit)

    def read(batches):
        for batch in batches:
            for doc_id, y, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "y", "text")), strict=True):
                own = sorted(terms(text or ""))
                yield pa.RecordBatch.from_arrays([pa.array([doc_id]), pa.array([y], pa.int32()), pa.array([copy_key(text or "")]),
                                                  pa.array([text or ""]), pa.array([own], pa.list_(pa.string()))], ["doc_id", "y", "copy", "text", "terms"])

    labelled = labelled_texts(docs, chosen)
    examples = saved(in_files(labelled, limit, EXAMPLE_ROWS).mapInArrow(read, "doc_id long, y int, copy string, text string, terms array<string>"), "examples")
    single = examples.groupBy("copy").agg(F.min(F.struct("doc_id", "y", "terms")).alias("first")).select("first.*")
    total = single.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
    n, p = float(total["n"]), float(total["p"] or 0)
    a, c = F.col("a").cast("double"), F.col("c").cast("double")
    chi = (a * (n - p) - (c - a) * p) ** 2 * n / (p * (n - p) * c * (n - c))
    kept = []
    if 0 < p < n:
        counts = single.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("y").alias("a"), F.count("*").alias("c"))
        kept = [r["term"] for r in counts.where((F.col("a") >= LEAST_EXAMPLES) & (a * n > c * p) & (c < n)).withColumn("chi", chi)
                .where(F.col("chi") >= LEAST_CHI).select("term").collect()]
    vocabulary = Vocabulary(sorted(kept))
    spelt = examples.select(F.explode("terms").alias("term")).where(~F.col("term").rlike("[*@]")).distinct()
    words = spelt.toArrow().column("term").combine_chunks()
    words = words.take(pc.sort_indices(words))
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, words))

    def frequencies(batches):
        vocabulary, words = shared.value
        lexicon = Lexicon(words)
        seen = np.zeros(1 + len(vocabulary.terms) + len(words), np.int64)  # of all texts, the terms, the words
        for batch in batches:
            for text in batch.column("text").to_pylist():
                chosen = vocabulary.counts(text or "")
                seen[0] += 1
                seen[np.fromiter(chosen, np.int64, len(chosen)) + 1] += 1
                seen[lexicon.uses(text or "")[0] + 1 + len(vocabulary.terms)] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at - 1), pa.array(seen[at])], ["term", "n"])

    df = docs.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros(1 + len(kept) + len(words))
    held[df.column("term").to_numpy() + 1] = df.column("n").to_numpy()
    idf = np.log((1 + held[0]) / (1 + held[1:])) + 1

    def vectors(batches):
        vocabulary, words = shared.value
        lexicon = Lexicon(words)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            own = [vocabulary.counts(x) for x in texts]
            lists = [[sorted(r) for r in own], [[r[t] for t in sorted(r)] for r in own], *zip(*map(lexicon.uses, texts), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *(pa.array(list(x), pa.list_(pa.int32())) for x in (lists if texts else [[]] * 4))],
                                             ["doc_id", "y", "t", "n", "word", "uses"])

    rows = (examples.select("doc_id", "y", "text").mapInArrow(vectors, "doc_id long, y int, t array<int>, n array<int>, word array<int>, uses array<int>")
            .orderBy("doc_id", "y", "word", "uses").toArrow())
    release(examples)
    shared.unpersist()
    lists = lambda name: (x.values.to_numpy() for x in rows.column(name))
    whole = WholeTexts(words, idf[len(kept):], list(zip(lists("word"), lists("uses"), strict=True)))
    model = Neighbours(vocabulary, idf[:len(kept)], rows.column("doc_id").to_pylist(), rows.column("y").to_numpy().astype(float),
                       (Counter(dict(zip(t.tolist(), n.tolist(), strict=True))) for t, n in zip(lists("t"), lists("n"), strict=True)), whole=whole)
    whole.rows = []
    give_back()
    return model


def score_toxicity(docs: DataFrame, model: Neighbours, *keep: str, evidence: int = 3, name: str = "score") -> DataFrame:
    """``keep`` columns of every row of docs with the score as ``name`` and its ``evidence``: the
    nearest examples with their cosine and label."""
    schema = docs.select(*keep).schema.add(name, "double").add("evidence", T.ArrayType(EVIDENCE))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def of(batches):
        model = shared.value
        for batch in slices(batches, "text", TEXT_BYTES):
            score, near = [], []
            for s, ids, cosines, labels in model.scores([text or "" for text in batch.column("text").to_pylist()]):
                score.append(s)
                near.append([{"doc_id": i, "cosine": c, "label": int(y)}
                             for i, c, y in zip(ids[:evidence].tolist(), cosines.tolist(), labels.tolist(), strict=False)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score, pa.float64()), pa.array(near, kind)],
                                             [*keep, name, "evidence"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(of, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) for every row of docs (doc_id, text).

    Null and empty texts, and texts without a word of the examples, get the share of label 1 among
    examples without a chosen term. Rows that repeat a doc_id are scored each; a doc_id labelled twice counts with its
    greatest label; other columns are not looked at. Without labelled rows the score is 0."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score_toxicity(docs, fit(docs, labels), "doc_id")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("evidence")

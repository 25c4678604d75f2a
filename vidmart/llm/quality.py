"""Document quality by a regularised quadratic discriminant.

A document is described by statistics of its whole text (shares of character kinds,
word lengths, repetition of words, pairs and lines), transformed towards a normal
shape: logarithms of counts, log odds of shares, then centred and scaled by the
training rows. Each class has a mean and a covariance, shrunk towards its diagonal and
towards the pooled covariance; its Cholesky factor is computed once and kept. The
score is the difference of the classes' log densities (Mahalanobis distances through
the factors, log determinants, priors), passed through a logistic curve that is fitted
to the training rows.

The model is fitted on at most ``MAX_TRAINING`` labelled rows (those with the least
hash of their doc_id), the one bounded sample here; every document is scored.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vidmart.llm.arrays import U, mix, prefix, runs, span, word_hashes
from vidmart.llm.common import documents, slices, text_arrays

MAX_TRAINING = 20_000
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
#: Shrinkage of a class covariance towards the pooled one, then towards its diagonal.
POOLED, DIAGONAL = 0.1, 0.1
#: Least number of training rows that a class needs; with fewer the score is the share of label 1.
LEAST_ROWS = 5

NAMES = ("bytes", "words", "lines", "word_bytes", "upper", "digits", "other_ascii", "non_ascii", "marks", "stops", "bangs", "pipes",
         "distinct_words", "top_word", "same_as_before", "distinct_pairs", "distinct_lines", "long_words", "short_words",
         "capital_words", "words_in_line", "marked_words")
_KIND = np.zeros((8, 256), bool)
for _row, _chars in enumerate((range(65, 91), range(48, 58), [c for c in range(33, 127) if not chr(c).isalnum()], range(128, 256),
                               b"#*$%&<>@^~=_+\\/{}[]", b".,;:?", b"!", b"|")):
    _KIND[_row, list(_chars)] = True


def _per_text(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(text, values, minlength=n)


def _repeats(text: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct values, and of the most common one, of each text."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (value[1:] != value[:-1])])[:len(text)]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(text)))
    top = np.zeros(n)
    first = runs(text[at])
    if len(at):
        top[text[at[first]]] = np.maximum.reduceat(count, first)
    return np.bincount(text[at], minlength=n).astype(float), top


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One transformed row of NAMES for each text; an empty text gives finite values too."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    words, text, start, end = word_hashes(raw, offsets)
    n_words = np.bincount(text, minlength=n).astype(float)
    length = (end - start).astype(float)
    sums = np.stack([np.concatenate([[0], np.cumsum(k[raw])]) for k in _KIND])
    kinds = (sums[:, offsets[1:]] - sums[:, offsets[:-1]]).astype(float)
    distinct, top = _repeats(text, words, n)
    pair = text[1:] == text[:-1]
    of_pair = text[1:][pair]
    pairs, _ = _repeats(of_pair, (words[:-1] * U(3) + mix(words[1:]))[pair], n)
    n_pairs = np.maximum(n_words - 1, 0)
    again = _per_text((words[1:] == words[:-1])[pair].astype(float), of_pair, n)
    # lines that have a word: words between line breaks
    breaks = np.concatenate([[0], np.cumsum(raw == 10)])
    line = breaks[start]
    new_line = np.concatenate([[True], (line[1:] != line[:-1]) | (text[1:] != text[:-1])])[:len(line)]
    at = np.flatnonzero(new_line)
    stop = np.append(at[1:], len(line))
    lines, _ = _repeats(text[at], span(prefix(words), at, stop), n)
    n_lines = np.bincount(text[at], minlength=n).astype(float)
    capital = _KIND[0][raw[start]] if len(start) else np.zeros(0, bool)
    mark = _KIND[4] | _KIND[6] | _KIND[7]
    marked = mark[raw[end - 1]] if len(start) else np.zeros(0, bool)

    def share(x, of):
        return np.log((x + 0.5) / (np.maximum(of - x, 0) + 0.5))  # log odds, defined for 0 of 0

    cols = [np.log1p(size), np.log1p(n_words), np.log1p(n_lines), np.log1p(_per_text(length, text, n) / np.maximum(n_words, 1)),
            *(share(k, size) for k in kinds), share(distinct, n_words), share(top, n_words), share(again, n_pairs), share(pairs, n_pairs),
            share(lines, n_lines), share(_per_text((length > 12).astype(float), text, n), n_words),
            share(_per_text((length <= 3).astype(float), text, n), n_words), share(_per_text(capital.astype(float), text, n), n_words),
            np.log1p(n_words / np.maximum(n_lines, 1)), share(_per_text(marked.astype(float), text, n), n_words)]
    return np.stack(cols, 1)


def described(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns of docs with ``x``, the statistics of the text."""
    schema = docs.select(*keep).schema.add("x", T.ArrayType(T.DoubleType()))

    def of(batches):
        for batch in slices(batches, "text"):
            x = statistics(*text_arrays(batch.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], [*keep, "x"])

    return docs.select(*keep, "text").mapInArrow(of, schema)


def fold(doc_id, folds: int):
    """crc32 of the doc_id's digits, modulo ``folds``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, limit: int) -> DataFrame:
    """(doc_id, y) of at most ``limit`` labelled rows outside the held-out fold, least hash first.

    A doc_id that is labelled twice counts once (its greatest label); null labels do not count."""
    rows = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
            .where(fold(F.col("doc_id"), folds) != held_out).groupBy("doc_id").agg(F.max("y").alias("y")))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def labelled_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, y, text) of the chosen rows, one for each doc_id: of rows that repeat it the least text."""
    return docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


class Discriminant:
    """Two normal densities with cached factors, and the curve from their log ratio to a score.

    Statistics are centred, scaled and cut at 8 deviations, so that no single one decides."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pooled: float = POOLED, diagonal: float = DIAGONAL):
        n, d = len(y), len(NAMES)
        self.share = float(y.mean()) if n else 0.5
        self.trained = bool(n) and min(int((y == k).sum()) for k in (0, 1)) >= LEAST_ROWS
        if not self.trained:
            return
        self.centre, self.scale = x.mean(0), x.std(0) + 1e-6
        z = self.shape(x)
        means = [z[y == k].mean(0) for k in (0, 1)]
        spread = [np.cov(z[y == k].T, bias=True).reshape(d, d) for k in (0, 1)]
        both = sum(s * (y == k).mean() for k, s in zip((0, 1), spread, strict=True))
        self.parts = []
        for k in (0, 1):
            s = (1 - pooled) * spread[k] + pooled * both
            s = (1 - diagonal) * s + diagonal * np.diag(np.diag(s)) + 1e-3 * np.eye(d)
            factor = np.linalg.cholesky(s)
            self.parts.append((means[k], np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum() - 2 * np.log((y == k).mean())))
        self.curve = fit_curve(self.ratio(z), y)

    def shape(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8, 8)

    def ratio(self, z: np.ndarray) -> np.ndarray:
        """Signed root of half the difference of the classes' -2 log densities (tames the tails)."""
        far = [((z - m) @ inv.T) ** 2 for m, inv, _ in self.parts]
        diff = (far[0].sum(1) + self.parts[0][2] - far[1].sum(1) - self.parts[1][2]) / 2
        return np.sign(diff) * np.sqrt(np.abs(diff))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(x), self.share)
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * self.ratio(self.shape(x)) + b, -40, 40)))


def fit_curve(r: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps halved until they improve.

    The ridge keeps the slope finite where the classes don't overlap."""
    scale = r.std() + 1e-9
    f = np.stack([r / scale, np.ones(len(r))], 1)
    hold = np.array([ridge, ridge / 100])

    def loss(w):
        z = f @ w
        return np.logaddexp(0, z).sum() - y @ z + (hold * w * w).sum() / 2

    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -40, 40)))
        g = f.T @ (p - y) + hold * w
        step = np.linalg.solve((f * (p * (1 - p))[:, None]).T @ f + np.diag(hold), g)
        t = 1.0
        while t > 1e-6 and loss(w - t * step) > loss(w):
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-6:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_TRAINING) -> Discriminant:
    """Train on a bounded sample: its statistics, ``limit`` short rows, come to the driver."""
    rows = described(labelled_texts(docs, training_rows(docs, labels, label, FOLDS, HELD_OUT, limit)), "doc_id", "y").orderBy("doc_id").toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(NAMES))
    return Discriminant(x, rows.column("y").to_numpy().astype(float))


def score_quality(docs: DataFrame, model: Discriminant, *keep: str, name: str = "score") -> DataFrame:
    """``keep`` columns of every row of docs, with the score of its whole text as ``name``."""
    schema = docs.select(*keep).schema.add(name, "double")

    def of(batches):
        for batch in slices(batches, "text"):
            x = statistics(*text_arrays(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(model.score(x))], [*keep, name])

    need = list(dict.fromkeys([*keep, "text"]))
    return docs.select(*need).mapInArrow(of, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text).

    Null and empty texts have statistics, so a score, like any other; rows that repeat a doc_id
    are scored each; other columns, and labels of unknown documents, are not looked at. Without
    enough labelled rows the score is their share of label 1 (0.5 without any)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score_quality(docs, fit(docs, labels), "doc_id")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

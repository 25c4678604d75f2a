"""Learning operators re-aimed at Spark ML.

Encoding, splitting, weighting, metrics and curves are plain DataFrame
aggregates (so they scale and are SQL-checkable); the classifier is a Spark
ML ``Pipeline`` (StringIndexer -> VectorAssembler -> GBTClassifier) that
saves and loads as one unit, so the fitted encoders travel with the model.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import RECOMMENDATION_DEFAULT, RECOMMENDATIONS
from .ranking import global_rank, running_totals


# Fixed values (the vocabularies a served model was trained on, and their defaults).
KNOWN_TOPICS = [
    "animals", "beauty", "business", "cars", "comedy", "education", "entertainment", "film", "finance", "fitness",
    "food", "gaming", "howto", "kids", "motivation", "music", "news", "nonprofit", "people", "pets", "science",
    "sports", "technology", "travel", "vlog",
]
KNOWN_REGIONS = [
    "Africa", "Central Asia", "East Asia", "Eastern Europe", "Middle East", "North America", "Oceania",
    "South America", "South Asia", "Southeast Asia", "Western Europe",
]
DEFAULT_TOPIC = "entertainment"
DEFAULT_REGION = "North America"


# --------------------------------------------------------------------------- encoding


def encode_categories(df: DataFrame, cols: Sequence[str], suffix: str = "_code") -> DataFrame:
    """Alphabetical label encoding (0..k-1) fitted on the data. The distinct
    values are numbered by a distributed rank, then joined back (small side)."""
    out = df
    for c in cols:
        vocab = df.select(c).where(F.col(c).isNotNull()).distinct()
        codes = global_rank(vocab, [c], name="_vm_code").select(
            F.col(c).alias("_vm_val"), (F.col("_vm_code") - 1).cast("int").alias(c + suffix))
        out = out.join(codes, out[c] == codes["_vm_val"], "left").drop("_vm_val")
    return out


def encode_known(col: Column | str, vocab: Sequence[str], default: str) -> Column:
    """Code in a fixed vocabulary; an unseen value takes the default's code."""
    c = F.col(col) if isinstance(col, str) else col
    v = F.array(*[F.lit(x) for x in vocab])
    known = F.when(c.isin(list(vocab)), c).otherwise(F.lit(default))
    return (F.array_position(v, known) - 1).cast("int")


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """neg/pos weight for the positive class (1.0 when there is no positive)."""
    g = df.agg(F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"))
    return g.withColumn("weight", F.when(F.col("n_pos") == 0, F.lit(1.0))
                        .otherwise(F.col("n_neg") / F.col("n_pos")))


#: Hex digits of the hash that one pass of the split counts, and the candidates that end the search.
SPLIT_DIGITS, SPLIT_ROWS = 4, 100_000


def stratified_split(df: DataFrame, label: str, id_col: str, seed: int = 42, test_frac: float = 0.2,
                     name: str = "split") -> DataFrame:
    """Exact per-class split: inside each class, rows ordered by
    md5(id || seed), then id; the last ceil(n_class * test_frac) are 'test'.

    No row is moved: each class's last train row is found by counting the rows by the first
    digits of the hash, then by the next ones inside the bucket that holds it, until few rows
    are left; the input is read once or twice for that, and once for the result. A class of
    equal ids on both sides of the cut is ranked by a distributed sort instead. Rows without a
    class are left out."""
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))
    d = df.withColumn("_vm_h", h).where(F.col(label).isNotNull())
    # per class: how many rows, and the rank wanted inside the bucket of hashes that begin with _vm_b
    counts = d.groupBy(label).agg(F.count(F.lit(1)).alias("_vm_n"))
    n_train = F.col("_vm_n") - F.ceil(F.col("_vm_n") * F.lit(test_frac))
    want = {r[0]: (r["w"], "", r["n"]) for r in counts.select(label, n_train.cast("bigint").alias("w"), F.col("_vm_n").alias("n")).collect()}
    digits = 0
    while any(w > 0 and size > SPLIT_ROWS for w, _, size in want.values()) and digits < 32:
        digits += SPLIT_DIGITS
        begin = F.substring("_vm_h", 1, digits)
        open_ = _any_of([(F.col(label) == F.lit(c)) & F.col("_vm_h").startswith(b) for c, (w, b, _) in want.items() if w > 0])
        buckets: dict = {}
        for r in d.where(open_).groupBy(label, begin.alias("b")).count().collect():
            buckets.setdefault(r[0], []).append((r["b"], r["count"]))
        for c, found in buckets.items():
            w, at = want[c][0], 0
            for b, n in sorted(found):
                if at + n >= w:
                    want[c] = (w - at, b, n)
                    break
                at += n
    cuts, tied = {}, False
    left = _any_of([(F.col(label) == F.lit(c)) & F.col("_vm_h").startswith(b) for c, (w, b, _) in want.items() if w > 0])
    rows: dict = {}
    for r in d.where(left).groupBy(label, "_vm_h", id_col).count().collect():
        rows.setdefault(r[0], []).append((r["_vm_h"], r[id_col], r["count"]))
    for c, found in rows.items():
        w, at = want[c][0], 0
        for key, i, n in sorted(found, key=lambda x: (x[0], x[1])):
            at += n
            if at >= w:
                cuts[c], tied = (key, i), tied or at > w
                break
    if tied:
        return _ranked_split(d, label, id_col, test_frac, name)
    train = _any_of([(F.col(label) == F.lit(c)) & ((F.col("_vm_h") < key) | ((F.col("_vm_h") == key) & (F.col(id_col) <= F.lit(i)))) for c, (key, i) in cuts.items()])
    return d.withColumn(name, F.when(train, "train").otherwise("test")).drop("_vm_h")


def _any_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _ranked_split(d: DataFrame, label: str, id_col: str, test_frac: float, name: str) -> DataFrame:
    """The same by a distributed range sort, which also tells equal ids apart."""
    ranked = global_rank(d, [label, "_vm_h", id_col], name="_vm_r")
    stats = ranked.groupBy(label).agg(F.min("_vm_r").alias("_vm_start"), F.count(F.lit(1)).alias("_vm_n"))
    j = ranked.join(stats, label)
    n_train = F.col("_vm_n") - F.ceil(F.col("_vm_n") * F.lit(test_frac))
    return j.withColumn(name, F.when(F.col("_vm_r") - F.col("_vm_start") + 1 <= n_train, "train").otherwise("test")) \
        .select(*[c for c in d.columns if c != "_vm_h"], name)


# --------------------------------------------------------------------------- model


def build_pipeline(cat_cols: Sequence[str], num_cols: Sequence[str], label: str, weight_col: str | None = None,
                   max_iter: int = 300, max_depth: int = 6, step: float = 0.05, subsample: float = 0.8,
                   feature_subset: str = "0.8", seed: int = 42) -> Pipeline:
    """Gradient-boosted trees with the reference hyper-parameters."""
    idx = [StringIndexer(inputCol=c, outputCol=c + "_idx", stringOrderType="alphabetAsc", handleInvalid="keep")
           for c in cat_cols]
    asm = VectorAssembler(inputCols=[*num_cols, *[c + "_idx" for c in cat_cols]], outputCol="features",
                          handleInvalid="keep")
    gbt = GBTClassifier(featuresCol="features", labelCol=label, maxIter=max_iter, maxDepth=max_depth, stepSize=step,
                        subsamplingRate=subsample, featureSubsetStrategy=feature_subset, seed=seed,
                        maxBins=64)
    if weight_col:
        gbt.setWeightCol(weight_col)
    return Pipeline(stages=[*idx, asm, gbt])


def score(model: PipelineModel, df: DataFrame, score_col: str = "score") -> DataFrame:
    """Class and positive-class probability for every row."""
    out = model.transform(df)
    return out.withColumn(score_col, vector_to_array("probability")[1]).withColumn(
        "prediction", F.col("prediction").cast("int"))


def feature_importance(model: PipelineModel, names: Sequence[str], spark) -> DataFrame:
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = sorted(zip(names, imp), key=lambda x: -x[1])
    return spark.createDataFrame(rows, "feature string, importance double")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# --------------------------------------------------------------------------- metrics


def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Per-class precision / recall / F1 / support plus macro, weighted and
    accuracy rows, from ONE aggregate over the four confusion counts."""
    y, p = F.col(label).cast("int"), F.col(pred).cast("int")
    c = df.agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
               F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))

    def prf(tp, fp, fn):
        pr = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
        rc = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
        f1 = F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(F.lit(0.0))
        return pr, rc, f1

    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p1, r1, f1 = prf(tp, fp, fn)
    p0, r0, f0 = prf(tn, fn, fp)
    s1, s0 = tp + fn, tn + fp
    n = s1 + s0

    def row(name, pr, rc, f, sup):
        return F.struct(F.lit(name).alias("class"), pr.cast("double").alias("precision"),
                        rc.cast("double").alias("recall"), f.cast("double").alias("f1"), sup.cast("bigint").alias("support"))

    rows = F.array(row("0", p0, r0, f0, s0), row("1", p1, r1, f1, s1),
                   row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
                   row("weighted avg", (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n),
                   row("accuracy", F.lit(None), F.lit(None), (tp + tn) / n, n))
    return c.select(F.explode(rows).alias("r")).select("r.*")


def _threshold_table(df: DataFrame, label: str, score_col: str) -> DataFrame:
    """One row per distinct score: positives, negatives and their running
    totals from the highest score down (distributed prefix sums)."""
    y = F.col(label).cast("long")
    g = df.where(F.col(score_col).isNotNull() & y.isNotNull()).groupBy(F.col(score_col).alias("threshold")) \
        .agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    return running_totals(g, [F.col("threshold").desc()], {"cum_tp": "pos", "cum_fp": "neg"})


def roc_auc(df: DataFrame, label: str, score_col: str) -> DataFrame:
    """ROC-AUC (trapezoid over distinct thresholds, ties on the diagonal) and
    average precision (step sum), one row."""
    t = _threshold_table(df, label, score_col)
    g = t.agg(F.sum(F.col("neg") * (2 * F.col("cum_tp") - F.col("pos"))).alias("_a"),
              F.sum(F.col("pos") * F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))).alias("_ap"),
              F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                 F.col("_a") / (2.0 * F.col("n_pos") * F.col("n_neg")))
    ap = F.when(F.col("n_pos") > 0, F.col("_ap") / F.col("n_pos"))
    return g.select(auc.alias("auc"), ap.alias("average_precision"), "n_pos", "n_neg")


def pr_curve(df: DataFrame, label: str, score_col: str) -> DataFrame:
    """Precision and recall at each distinct threshold."""
    t = _threshold_table(df, label, score_col)
    n_pos = t.agg(F.sum("pos")).scalar()
    return t.select("threshold", (F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))).alias("precision"),
                    F.when(n_pos > 0, F.col("cum_tp") / n_pos).alias("recall"))


def roc_curve(df: DataFrame, label: str, score_col: str) -> DataFrame:
    t = _threshold_table(df, label, score_col)
    tot = t.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return t.select("threshold", (F.col("cum_fp") / tot.select("n").scalar()).alias("fpr"),
                    (F.col("cum_tp") / tot.select("p").scalar()).alias("tpr"))


# --------------------------------------------------------------------------- explanations


def fit_surrogate(df: DataFrame, features: Sequence[str], label: str) -> tuple[dict, dict]:
    """Linear surrogate (logistic regression) on the same features; returns
    coefficients and feature means (both small: one value per feature). A NULL
    feature counts as its mean, in the fit as in the contributions."""
    means = df.agg(*[F.avg(c).alias(c) for c in features]).first().asDict()
    asm = VectorAssembler(inputCols=list(features), outputCol="_vm_x")
    lr = LogisticRegression(featuresCol="_vm_x", labelCol=label, maxIter=50)
    m = Pipeline(stages=[asm, lr]).fit(df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(means[c] or 0.0))) for c in features}))
    coef = dict(zip(features, m.stages[-1].coefficients.toArray().tolist()))
    return coef, means


def contributions(df: DataFrame, coef: Mapping[str, float], means: Mapping[str, float], k: int = 5,
                  name: str = "top_contributions") -> DataFrame:
    """Per-row additive contributions coef_i * (x_i - mean_i) (exact SHAP of a
    linear model under feature independence), top-k by magnitude."""
    items = F.array(*[F.struct(F.lit(f).alias("feature"),
                               (F.lit(float(coef[f])) * F.coalesce(F.col(f).cast("double") - F.lit(float(means[f] or 0.0)), F.lit(0.0)))
                               .alias("value")) for f in coef])
    ranked = F.array_sort(items, lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1)
                          .when(F.abs(a["value"]) < F.abs(b["value"]), 1).otherwise(0))
    return df.withColumn("all_contributions", ranked).withColumn(name, F.slice("all_contributions", 1, k))


def recommend(contrib: Column | str, limit: int = 4) -> Column:
    """One text per negative contribution, largest magnitude first, at most
    ``limit``; a fixed text when none is negative."""
    c = F.col(contrib) if isinstance(contrib, str) else contrib
    texts = F.create_map(*[x for kv in RECOMMENDATIONS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    neg = F.filter(c, lambda s: (s["value"] < 0) & F.array_contains(F.map_keys(texts), s["feature"]))
    recs = F.slice(F.transform(neg, lambda s: texts[s["feature"]]), 1, limit)
    return F.when(F.size(recs) > 0, recs).otherwise(F.array(F.lit(RECOMMENDATION_DEFAULT)))

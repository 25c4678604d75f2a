"""Driver queries: learning operators (L1-L13) on documents ⋈ labels."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ...functions.text import RECOMMENDATION_DEFAULT, RECOMMENDATIONS
from ...operators import ml as ML
from ...operators import shap as SHAP
from ...operators.ranking import quantile_columns
from .registry import query, r6, sql_case, sql_lit, table


def labelled_docs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.join(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id")


LABELLED_SQL = "(SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


@query("encode_categories", f"""
SELECT doc_id, lang, source, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS lang_code,
       CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS source_code
FROM {LABELLED_SQL}
""")
def encode_categories(spark, sf):
    d = labelled_docs(spark, sf).select("doc_id", "lang", "source")
    return ML.encode_categories(d, ["lang", "source"])


VOCAB = ["de", "en", "fr", "vi"]


@query("encode_known", f"""
SELECT doc_id, lang, CAST(list_position({VOCAB}, CASE WHEN lang IN ('de', 'en', 'fr', 'vi') THEN lang ELSE 'en' END) - 1
       AS INTEGER) AS lang_code
FROM {LABELLED_SQL}
""")
def encode_known(spark, sf):
    d = labelled_docs(spark, sf)
    return d.select("doc_id", "lang", ML.encode_known("lang", VOCAB, "en").alias("lang_code"))


@query("class_weight", """
SELECT count(*) FILTER (WHERE quality = 1) AS n_pos, count(*) FILTER (WHERE quality = 0) AS n_neg,
       CASE WHEN count(*) FILTER (WHERE quality = 1) = 0 THEN 1.0
            ELSE count(*) FILTER (WHERE quality = 0) / count(*) FILTER (WHERE quality = 1) END AS weight
FROM labels
""")
def class_weight(spark, sf):
    return ML.class_weight(table(spark, sf, "labels"), "quality")


@query("stratified_split", f"""
WITH d AS (SELECT doc_id, quality, md5(CAST(doc_id AS VARCHAR) || '42') AS h FROM {LABELLED_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY h, doc_id) AS rn,
             count(*) OVER (PARTITION BY quality) AS n FROM d)
SELECT doc_id, quality, CASE WHEN rn <= n - ceil(n * 0.2) THEN 'train' ELSE 'test' END AS split FROM r
""")
def stratified_split(spark, sf):
    d = labelled_docs(spark, sf).select("doc_id", "quality")
    return ML.stratified_split(d, "quality", "doc_id", seed=42, test_frac=0.2)


def _scored(spark, sf):
    """Rule-based score for the metric operators: score = n_chars,
    prediction = n_chars above the median."""
    d = labelled_docs(spark, sf)
    med = quantile_columns(d, "n_chars", {"p50": 0.5}).select("p50").scalar()
    return d.withColumn("prediction", (F.col("n_chars") > med).cast("int"))


def _report_sql():
    pr = """
WITH s AS (SELECT quality, CAST(n_chars > (SELECT quantile_cont(n_chars, 0.5) FROM {src}) AS INTEGER) AS pred FROM {src}),
c AS (SELECT count(*) FILTER (WHERE quality = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND pred = 1) AS fp,
             count(*) FILTER (WHERE quality = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE quality = 0 AND pred = 0) AS tn
      FROM s),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p1,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r1,
             CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0.0 END AS p0,
             CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS r0,
             tp + fn AS s1, tn + fp AS s0 FROM c),
f AS (SELECT *, CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0.0 END AS f1,
             CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0.0 END AS f0, s0 + s1 AS n FROM m)
SELECT '0' AS class, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, s0 AS support FROM f
UNION ALL SELECT '1', round(p1, 6), round(r1, 6), round(f1, 6), s1 FROM f
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), n FROM f
UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / n, 6), round((r0 * s0 + r1 * s1) / n, 6),
                 round((f0 * s0 + f1 * s1) / n, 6), n FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round((tp + tn) / n, 6), n FROM f
"""
    return pr.replace("{src}", LABELLED_SQL)


@query("classification_report", _report_sql())
def classification_report(spark, sf):
    r = ML.classification_report(_scored(spark, sf), "quality", "prediction")
    return r.select("class", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"),
                    "support")


_THRESH_SQL = f"""
WITH g AS (SELECT n_chars AS threshold, sum(quality) AS pos, sum(1 - quality) AS neg FROM {LABELLED_SQL}
           WHERE n_chars IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
t AS (SELECT *, sum(pos) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS cum_tp,
             sum(neg) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS cum_fp FROM g)"""


@query("roc_auc", f"""
{_THRESH_SQL}
SELECT round(sum(neg * (2 * cum_tp - pos)) / (2.0 * sum(pos) * sum(neg)), 6) AS auc,
       round(sum(pos * cum_tp / (cum_tp + cum_fp)) / sum(pos), 6) AS average_precision,
       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg
FROM t
""")
def roc_auc(spark, sf):
    r = ML.roc_auc(labelled_docs(spark, sf), "quality", "n_chars")
    return r.select(r6("auc").alias("auc"), r6("average_precision").alias("average_precision"),
                    F.col("n_pos").cast("bigint").alias("n_pos"), F.col("n_neg").cast("bigint").alias("n_neg"))


@query("pr_curve", f"""
{_THRESH_SQL}
SELECT threshold, round(cum_tp / (cum_tp + cum_fp), 6) AS precision,
       round(cum_tp / (SELECT sum(pos) FROM g), 6) AS recall
FROM t
""")
def pr_curve(spark, sf):
    p = ML.pr_curve(labelled_docs(spark, sf), "quality", "n_chars")
    return p.select("threshold", r6("precision").alias("precision"), r6("recall").alias("recall"))


@query("roc_curve", f"""
{_THRESH_SQL}
SELECT threshold, round(cum_fp / (SELECT sum(neg) FROM g), 6) AS fpr, round(cum_tp / (SELECT sum(pos) FROM g), 6) AS tpr
FROM t
""")
def roc_curve(spark, sf):
    c = ML.roc_curve(labelled_docs(spark, sf), "quality", "n_chars")
    return c.select("threshold", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@query("encode_served", """
SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 30 < 25 THEN o_orderkey % 30 ELSE 6 END AS INTEGER) AS topic_code,
       CAST(CASE WHEN o_orderkey % 13 < 11 THEN o_orderkey % 13 ELSE 5 END AS INTEGER) AS region_code
FROM orders
""")
def encode_served(spark, sf):
    """The fixed vocabularies of the served model; unseen and missing values take the default's code."""
    def value(vocab, n):
        return F.coalesce(F.get(F.array(*map(F.lit, vocab)), (F.col("o_orderkey") % n).cast("int")),
                          F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")))
    return table(spark, sf, "orders").select(
        "o_orderkey", ML.encode_known(value(ML.KNOWN_TOPICS, 30), ML.KNOWN_TOPICS, ML.DEFAULT_TOPIC).alias("topic_code"),
        ML.encode_known(value(ML.KNOWN_REGIONS, 13), ML.KNOWN_REGIONS, ML.DEFAULT_REGION).alias("region_code"))


FEATURES_NUM = ["log_chars", "n_words", "n_lines", "word_chars", "digit_rate", "upper_rate", "symbol_rate"]
FEATURES_CAT = ["lang", "source"]
FEATURES = [*FEATURES_NUM, *[c + "_idx" for c in FEATURES_CAT]]
#: Trees of the registered fit; ``build_pipeline`` itself defaults to 300, one Spark job per tree level.
TREES = 20


def _model_input(spark, sf):
    """Nine features: seven of the whole text, and two categories."""
    t = F.coalesce("text", F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))

    def share(drop):
        return (F.length(t) - F.length(F.regexp_replace(t, drop, ""))) / n

    d = table(spark, sf, "documents").select(
        "doc_id", "lang", "source", F.log1p(F.length(t)).alias("log_chars"), words.cast("double").alias("n_words"),
        F.size(F.split(t, "\n")).cast("double").alias("n_lines"), (n / F.greatest(words, F.lit(1))).alias("word_chars"),
        share("[0-9]").alias("digit_rate"), share(r"\p{Lu}").alias("upper_rate"), share("[#*$%&|<>]").alias("symbol_rate"))
    return d.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query("train_eval", f"""
WITH d AS (SELECT doc_id, quality, md5(CAST(doc_id AS VARCHAR) || '42') AS h FROM {LABELLED_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY h, doc_id) AS rn,
             count(*) OVER (PARTITION BY quality) AS n FROM d),
s AS (SELECT quality, rn <= n - ceil(n * 0.2) AS train FROM r)
SELECT 'n_train' AS metric, CAST(count(*) FILTER (WHERE train) AS DOUBLE) AS value FROM s
UNION ALL SELECT 'support_0', count(*) FILTER (WHERE NOT train AND quality = 0) FROM s
UNION ALL SELECT 'support_1', count(*) FILTER (WHERE NOT train AND quality = 1) FROM s
UNION ALL SELECT 'support_accuracy', count(*) FILTER (WHERE NOT train) FROM s
UNION ALL SELECT 'n_features', {len(FEATURES_NUM) + len(FEATURES_CAT)}
UNION ALL SELECT 'importance_sum', 1
UNION ALL SELECT 'better_than_chance', 1
""")
def train_eval(spark, sf):
    """Fit the GBT pipeline on the train split (class-weighted), score the test split; what does
    not depend on the trees has a twin (``train_report`` gives what does)."""
    train, model, scored = _fitted(spark, sf)

    def metric(df, name, value):
        return df.select((F.lit(name) if isinstance(name, str) else name).alias("metric"), value.cast("double").alias("value"))

    support = ML.classification_report(scored, "quality", "prediction").where(F.col("class").isin("0", "1", "accuracy"))
    imp = ML.feature_importance(model, FEATURES, spark)
    return (metric(train.agg(F.count("*").alias("n")), "n_train", F.col("n"))
            .unionByName(metric(support, F.concat(F.lit("support_"), F.col("class")), F.col("support")))
            .unionByName(metric(imp.agg(F.count("*").alias("n")), "n_features", F.col("n")))
            .unionByName(metric(imp.agg(F.sum("importance").alias("s")), "importance_sum", F.round("s", 6)))
            .unionByName(metric(ML.roc_auc(scored, "quality", "score"), "better_than_chance", F.col("auc") > 0.5)))


@query("train_report")
def train_report(spark, sf):
    """Precision, recall and F1 by class, accuracy, AUC, average precision and the importance of
    each feature of the fit on the test split (L6, L7, L10; rows only: they depend on the trees)."""
    _, model, scored = _fitted(spark, sf)
    rep = ML.classification_report(scored, "quality", "prediction")
    cells = F.explode(F.array(*[F.struct(F.concat(F.lit(m + "_"), F.col("class")).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("precision", "recall", "f1")]))
    auc = ML.roc_auc(scored, "quality", "score").select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("auc", "average_precision")])).alias("c"))
    imp = ML.feature_importance(model, FEATURES, spark).select(F.concat(F.lit("importance_"), "feature").alias("metric"), F.col("importance").alias("value"))
    return rep.select(cells.alias("c")).select("c.*").where("value is not null").unionByName(auc.select("c.*")).unionByName(imp)


@query("tree_contributions", f"SELECT doc_id, true AS adds_up, {len(FEATURES_NUM) + len(FEATURES_CAT)} AS n_features FROM {LABELLED_SQL}")
def tree_contributions(spark, sf):
    """Shapley values of the fitted trees for every labelled document: with the base value they
    add up to the margin that the model itself gives."""
    d = _model_input(spark, sf)
    model = ML.build_pipeline(FEATURES_CAT, FEATURES_NUM, "quality", max_iter=5).fit(d)
    c = SHAP.tree_contributions(model, model.transform(d).withColumn("margin", vector_to_array("rawPrediction")[1]), FEATURES)
    total = F.aggregate("all_contributions", F.col("base_value"), lambda a, x: a + x["value"])
    return c.select("doc_id", (F.abs(total - F.col("margin")) < 1e-9).alias("adds_up"), F.size("all_contributions").alias("n_features"))


def _fitted(spark, sf):
    """Train rows, the model fitted on them, and the scored test rows."""
    d = ML.stratified_split(_model_input(spark, sf), "quality", "doc_id")
    train, test = d.where(F.col("split") == "train"), d.where(F.col("split") == "test")
    w = ML.class_weight(train, "quality").select("weight").scalar()
    weighted = train.withColumn("w", F.when(F.col("quality") == 1, w).otherwise(F.lit(1.0)))
    model = ML.build_pipeline(FEATURES_CAT, FEATURES_NUM, "quality", weight_col="w", max_iter=TREES).fit(weighted)
    return train, model, ML.score(model, test)


#: Snapshot columns in the roles of the served features, with coefficients and means of a linear model.
ROLES = {"like_rate": "l_discount", "comment_rate": "l_tax", "duration_seconds": "l_extendedprice",
         "video_count": "l_quantity", "publish_hour": "l_linenumber"}
COEF = {"like_rate": 8.0, "comment_rate": -9.0, "duration_seconds": 0.00001, "video_count": -0.02, "publish_hour": 0.125}
MEANS = {"like_rate": 0.05, "comment_rate": 0.04, "duration_seconds": 35000.0, "video_count": 25.0, "publish_hour": 4.0}


def _ranked_sql():
    value = {f: f"(CAST({COEF[f]!r} AS DOUBLE) * (CAST({c} AS DOUBLE) - CAST({MEANS[f]!r} AS DOUBLE)))" for f, c in ROLES.items()}
    items = ", ".join(f"{{'a': -abs({v}), 'i': {i}, 'f': '{f}', 'v': {v}}}" for i, (f, v) in enumerate(value.items()))
    return f"(SELECT l_orderkey, l_linenumber, list_sort([{items}]) AS s FROM lineitem)"


def _contributed(spark, sf, k):
    li = table(spark, sf, "lineitem")
    return ML.contributions(li.select("l_orderkey", "l_linenumber", *[F.col(c).alias(f) for f, c in ROLES.items()]), COEF, MEANS, k)


@query("contributions", f"""
SELECT l_orderkey, l_linenumber, s[1].f || ',' || s[2].f || ',' || s[3].f AS top_features, s[1].v AS top_value
FROM {_ranked_sql()}
""")
def contributions(spark, sf):
    top = F.col("top_contributions")
    return _contributed(spark, sf, 3).select(
        "l_orderkey", "l_linenumber", F.array_join(top["feature"], ",").alias("top_features"), top[0]["value"].alias("top_value"))


@query("recommend", f"""
SELECT l_orderkey, l_linenumber, CASE WHEN len(t) = 0 THEN {sql_lit(RECOMMENDATION_DEFAULT)} ELSE array_to_string(t[1:4], ' | ') END AS recommendations
FROM (SELECT l_orderkey, l_linenumber, [{sql_case("x.f", RECOMMENDATIONS)} FOR x IN s IF x.v < 0] AS t FROM {_ranked_sql()})
""")
def recommend(spark, sf):
    return _contributed(spark, sf, 5).select(
        "l_orderkey", "l_linenumber", F.array_join(ML.recommend("all_contributions"), " | ").alias("recommendations"))


@query("top_contributions")
def top_contributions(spark, sf):
    """Per document the contributions of a fitted linear surrogate and the recommendation texts
    for the negative ones (rows only); text length, source and language take the roles of
    duration, topic and region."""
    d = ML.encode_categories(_model_input(spark, sf), ["lang", "source"]).withColumnsRenamed(
        {"log_chars": "duration_seconds", "source_code": "topic", "lang_code": "country_region"})
    coef, means = ML.fit_surrogate(d, ["duration_seconds", "topic", "country_region"], "quality")
    c = ML.contributions(d, coef, means, k=5)
    return c.select("doc_id", F.array_join(F.col("top_contributions")["feature"], ",").alias("top_features"),
                    F.array_join(ML.recommend("all_contributions"), " | ").alias("recommendations"))

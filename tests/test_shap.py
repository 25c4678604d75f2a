"""Tree contributions against all subsets of features."""

import random
from itertools import combinations
from math import factorial

import pytest
from pyspark.ml.functions import vector_to_array

from vidmart.operators import ml as ML
from vidmart.operators import shap as SHAP


def brute(nodes, x, width):
    """Shapley values from the expectation of every subset of known features, tree by tree."""
    by = {(n["tree"], n["id"]): n for n in nodes}

    def expected(n, known):
        if n["left"] < 0:
            return n["prediction"] * n["weight"]
        left, right = by[n["tree"], n["left"]], by[n["tree"], n["right"]]
        if n["feature"] in known:
            goes = x[n["feature"]] in n["at"] if n["arity"] >= 0 else x[n["feature"]] <= n["at"][0]
            return expected(left if goes else right, known)
        return (expected(left, known) * left["rows"] + expected(right, known) * right["rows"]) / n["rows"]

    def model(known):
        return sum(expected(by[t, 0], known) for t in {n["tree"] for n in nodes})

    out = []
    for i in range(width):
        rest = [j for j in range(width) if j != i]
        out.append(sum(factorial(len(s)) * factorial(width - len(s) - 1) / factorial(width) * (model({*s, i}) - model({*s}))
                       for n in range(width) for s in combinations(rest, n)))
    return out


def test_values_equal_all_subsets_and_add_up(spark):
    rng = random.Random(6)
    data = [(i, rng.random(), rng.choice([0.0, 1.0, 2.0]), rng.gauss(0, 1), rng.choice("abcd")) for i in range(400)]
    df = spark.createDataFrame([(*r, int(r[1] + r[2] * r[3] + (r[4] == "b") > 0.8)) for r in data], "id long, a double, b double, c double, g string, y int")
    model = ML.build_pipeline(["g"], ["a", "b", "c"], "y", max_iter=4, max_depth=4, step=0.3).fit(df)
    scored = model.transform(df)
    names = ["a", "b", "c", "g_idx"]
    nodes = [r.asDict() for r in SHAP.node_table(model, spark).collect()]
    assert any(n["arity"] >= 0 for n in nodes if n["left"] >= 0)
    margins = {r["id"]: (r["m"], r["x"]) for r in scored.select("id", vector_to_array("rawPrediction")[1].alias("m"), vector_to_array("features").alias("x")).collect()}
    got = SHAP.tree_contributions(model, scored, names, k=2).collect()
    assert len(got) == 400
    for r in got:
        values = {c["feature"]: c["value"] for c in r["all_contributions"]}
        assert r["base_value"] + sum(values.values()) == pytest.approx(margins[r["id"]][0], abs=1e-9)
        size = [abs(c["value"]) for c in r["all_contributions"]]
        assert size == sorted(size, reverse=True) and r["top_contributions"] == r["all_contributions"][:2]
        if r["id"] % 40 == 0:
            assert [values[f] for f in names] == pytest.approx(brute(nodes, margins[r["id"]][1], 4), abs=1e-9)

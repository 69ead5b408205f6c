import itertools

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tideline.operators import models
from tideline.plans import registry

LEVELS = [float(v) for v in range(6)]


@pytest.fixture(scope="module")
def fitted(spark):
    """Trees over all combinations of three columns, where the weighted walk equals the mean over all rows."""
    rows = [(a, b, c, float((a - 2.5) * (b - 2.5) + c > 2)) for a, b, c in itertools.product(LEVELS, repeat=3)]
    df = spark.createDataFrame(rows, "a double, b double, c double, win double")
    return df, models.pipeline(["a", "b", "c"], [], "win", "trees", rounds=8).fit(df)


def brute(model, df, columns, points):
    """Mean margin over all rows with the columns set to each point."""
    out = []
    for p in points:
        moved = df.withColumns({c: F.lit(float(v)) for c, v in zip(columns, p, strict=True)})
        out.append(model.transform(moved).agg(F.avg(vector_to_array("rawPrediction")[1])).first()[0])
    return np.array(out)


def test_dependence_matches_brute_force(fitted):
    df, model = fitted
    trees = models.tree_nodes(model.stages[-1])
    points = [(0.0, 5.0), (2.0, 2.0), (3.0, 1.0), (5.0, 5.0)]
    assert np.allclose(models.dependence(trees, (0, 1), np.array(points)), brute(model, df, ["a", "b"], points))
    single = [(v,) for v in (0.0, 3.0, 5.0)]
    assert np.allclose(models.dependence(trees, (2,), np.array(single)), brute(model, df, ["c"], single))


def test_strengths_match_brute_force(fitted):
    df, model = fitted
    got = {(a, b): h for a, b, h in models.interaction_strengths(model, df, ["a", "b", "c"])}
    one = {c: (d := brute(model, df, [c], [(v,) for v in LEVELS])) - d.mean() for c in "abc"}
    for a, b in itertools.combinations("abc", 2):
        joint = brute(model, df, [a, b], list(itertools.product(LEVELS, repeat=2))).reshape(6, 6)
        joint -= joint.mean()
        assert got[(a, b)] == pytest.approx(((joint - one[a][:, None] - one[b]) ** 2).sum() / (joint**2).sum())
    assert max(got, key=got.get) == ("a", "b")
    assert [x[:2] for x in models.interaction_strengths(model, df, ["a", "b", "c"], top=1)] == [("a", "b")]


def test_knots_are_values_or_even_steps(spark):
    df = spark.createDataFrame([(float(i % 4), float(i)) for i in range(101)] + [(None, float("nan"))], "few double, many double")
    at = models.knots(df, ["few", "many"], 5)
    assert at["few"].tolist() == [0.0, 1.0, 2.0, 3.0] and np.allclose(at["many"], np.linspace(5, 95, 5))


def test_permutation_importance_is_the_mean_loss(spark):
    df = spark.range(300).select(F.col("id"), (F.rand(1) * 2 - 1).alias("a"), F.rand(2).alias("noise")).withColumn("win", (F.col("a") > 0).cast("double"))
    model = models.pipeline(["a", "noise"], [], "win").fit(df)
    base = models.quality(models.scored(model, df, "win"))[0]
    once = models.quality(models.scored(model, models.shuffled(df, "a", 0), "win"))[0]
    got = dict(models.permutation_importance(model, df, ["a", "noise"], "win", 1))
    assert got["a"] == pytest.approx(base - once) and got["a"] > 0.3 and abs(got["noise"]) < 0.05
    mixed = models.shuffled(df, "a", 5)
    assert mixed.count() == 300 and sorted(r.a for r in mixed.collect()) == sorted(r.a for r in df.collect())
    assert {(r.id, r.noise) for r in mixed.collect()} == {(r.id, r.noise) for r in df.collect()}


def test_query_of_strengths(spark):
    rows = registry.QUERIES["sta07_interaction_strengths"](spark, "/root/testdata/sf0.001").collect()
    assert [r.place for r in rows] == list(range(1, 11)) and [r.h2 for r in rows] == sorted((r.h2 for r in rows), reverse=True)
    assert all(0 <= r.h2 <= 1 for r in rows) and len({(r.feature_a, r.feature_b) for r in rows}) == 10

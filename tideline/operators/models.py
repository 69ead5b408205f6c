"""Cross-validated outcome models, permutation importance and interaction strengths, with pyspark.ml."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.stats import quantiles
from tideline.session import Scratch

#: Levels of fewer rows than this are one.
LEAST_LEVEL = 10
#: The inverse strength of the penalty of a logit, as sums and not means of losses have it.
STRENGTH = 0.1
RARE = "(rare)"


def folds(df: DataFrame, group: str, n: int = 5, seed: int = 7, label: str | None = None, buckets: int = 64) -> DataFrame:
    """Add fold: all rows of a group share one. With a label, groups of like outcomes and sizes are dealt out in turn, in
    a drawn order and within buckets of a hash, so that folds have like shares of both and no task has all groups."""
    drawn = F.xxhash64(F.lit(seed), group)
    if label is None:
        return df.withColumn("fold", F.pmod(drawn, F.lit(n)).cast("int"))
    sizes = df.groupBy(group).agg(F.round(F.avg(F.col(label).cast("double")) * 4).alias("_rate"), F.floor(F.log2(F.count(F.lit(1)))).alias("_size"))
    bucket = F.pmod(drawn, F.lit(buckets))
    place = F.row_number().over(Window.partitionBy("_rate", "_size", bucket).orderBy(drawn))
    dealt = sizes.select(group, F.pmod(place + bucket, F.lit(n)).cast("int").alias("fold"))
    return df.join(dealt, group)


def level_counts(df: DataFrame, categorical: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """variable, level and n of the rows of each level that isn't null (and by, if named), in one pass."""
    cast = df.select(*by, *(F.col(c).cast("string").alias(c) for c in categorical)).unpivot(list(by), categorical, "variable", "level")
    return cast.where("level IS NOT NULL").groupBy("variable", "level", *by).agg(F.count(F.lit(1)).alias("n"))


def pool_rare(train: DataFrame, test: DataFrame, categorical: list[str], least: int = LEAST_LEVEL, counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Both frames with the levels that the first has in fewer rows than least, and null, as one level. counts: its
    ``level_counts``, if they are known. Levels are broadcast, as the indexer has all of them on the driver anyway."""
    if categorical and counts is None:
        counts = level_counts(train, categorical)
    for c in categorical:
        often = F.broadcast(counts.where((F.col("variable") == c) & (F.col("n") >= least)).select(F.col("level").alias("_level")))
        put = lambda df: df.join(often, df[c].cast("string") == often["_level"], "left").withColumn(c, F.coalesce("_level", F.lit(RARE))).drop("_level")  # noqa: B023, E731
        train, test = put(train), put(test)
    return train, test


def pipeline(numeric: list[str], categorical: list[str], label: str, kind: str = "logit", penalty: float = 0.02, rounds: int = 20) -> Pipeline:
    """Median imputation, scaling, one-hot codes and an elastic-net logit or boosted trees."""
    filled = [f"{c}_filled" for c in numeric]
    indexed = [f"{c}_index" for c in categorical]
    stages = [Imputer(strategy="median", inputCols=numeric, outputCols=filled)]
    inputs = list(filled)
    if categorical:
        stages.append(StringIndexer(inputCols=categorical, outputCols=indexed, handleInvalid="keep"))
        if kind == "logit":
            stages.append(OneHotEncoder(inputCols=indexed, outputCols=[f"{c}_hot" for c in categorical]))
        inputs += [f"{c}_hot" for c in categorical] if kind == "logit" else indexed
    raw = "raw_features" if kind == "logit" else "features"
    stages.append(VectorAssembler(inputCols=inputs, outputCol=raw))
    if kind == "logit":
        stages.append(StandardScaler(inputCol=raw, outputCol="features"))
        stages.append(LogisticRegression(labelCol=label, regParam=penalty, elasticNetParam=0.5, maxIter=100))
    else:
        stages.append(GBTClassifier(labelCol=label, maxIter=rounds, maxDepth=3, stepSize=0.06, seed=7))
    return Pipeline(stages=stages)


def scored(model, df: DataFrame, label: str) -> DataFrame:
    out = model.transform(df)
    return out.select(*df.columns, vector_to_array("probability")[1].alias("prob"), F.col(label).cast("double").alias("_y"))


def quality(predictions: DataFrame) -> tuple[float, float]:
    """Area under the curve and Brier score."""
    auc = BinaryClassificationEvaluator(rawPredictionCol="prob", labelCol="_y").evaluate(predictions)
    return auc, predictions.agg(F.avg((F.col("prob") - F.col("_y")) ** 2)).first()[0]


def cross_validate(df: DataFrame, numeric: list[str], categorical: list[str], label: str, group: str, kind: str = "logit", n: int = 5, rounds: int = 20) -> tuple[DataFrame, list]:
    """Predictions of every row by the model of the other folds, and the models; folds share the outcomes evenly. Levels
    are counted by fold once, so that the fits' passes over a fold's rows shuffle nothing."""
    scratch = Scratch(df.sparkSession, "folds")
    marked = scratch.save(folds(df, group, n, label=label).select(*df.columns, "fold"))
    sizes = {r["fold"]: r["count"] for r in marked.groupBy("fold").count().collect()}
    by_fold = scratch.save(level_counts(marked, categorical, ("fold",))) if categorical else None
    out, models = None, []
    for k in range(n):
        counts = by_fold.where(F.col("fold") != k).groupBy("variable", "level").agg(F.sum("n").alias("n")) if categorical else None
        train, test = pool_rare(marked.where(F.col("fold") != k), marked.where(F.col("fold") == k), categorical, counts=counts)
        size = sum(v for fold, v in sizes.items() if fold != k)
        model = pipeline(numeric, categorical, label, kind, 1 / (STRENGTH * max(1, size)), rounds).fit(train)
        part = scored(model, test, label)
        out = part if out is None else out.unionByName(part)
        models.append(model)
    return out, models


def shuffled(df: DataFrame, column: str, seed: int) -> DataFrame:
    """df with a column's values dealt out anew: rows are numbered in two drawn orders within buckets of a hash, so no
    task sorts them all."""
    parts = max(1, df.rdd.getNumPartitions())
    rows = Scratch(df.sparkSession, "shuffled").save(df.withColumn("_id", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(parts)))
    place = lambda s: F.row_number().over(Window.partitionBy("_part").orderBy(F.xxhash64("_id", F.lit(s))))
    left = rows.withColumn("_n", place(seed + 1)).drop(column)
    right = rows.withColumn("_n", place(seed + 2)).select("_part", "_n", column)
    return left.join(right, ["_part", "_n"]).drop("_part", "_n", "_id")


def permutation_importance(model, held_out: DataFrame, columns: list[str], label: str, repeats: int = 8) -> list[tuple[str, float]]:
    """Mean loss of the area under the curve when a column is shuffled, largest first."""
    base, _ = quality(scored(model, held_out, label))
    out = []
    for c in columns:
        losses = [base - quality(scored(model, shuffled(held_out, c, 100 * r), label))[0] for r in range(repeats)]
        out.append((c, sum(losses) / repeats))
    return sorted(out, key=lambda x: -x[1])


def tree_nodes(model) -> list[tuple[float, list[tuple]]]:
    """Of fitted trees: the weight of each, and its nodes in preorder as (feature, threshold, left, right, share of the
    node's rows that go left, prediction); a leaf has feature -1, a split by categories -2."""
    out = []
    for weight, tree in zip(model.treeWeights, model.trees, strict=True):
        nodes: list[tuple] = []

        def walk(node, nodes=nodes) -> int:
            at = len(nodes)
            nodes.append(())
            if node.subtreeDepth() == 0:
                nodes[at] = (-1, 0.0, 0, 0, 0.0, node.prediction())
                return at
            split, count = node.split(), node.impurityStats().count()
            by_value = split.getClass().getSimpleName() == "ContinuousSplit"
            share = node.leftChild().impurityStats().count() / count
            left, right = walk(node.leftChild()), walk(node.rightChild())
            nodes[at] = (split.featureIndex() if by_value else -2, split.threshold() if by_value else 0.0, left, right, share, node.prediction())
            return at

        walk(tree._java_obj.rootNode())
        out.append((weight, nodes))
    return out


def dependence(trees: list[tuple[float, list[tuple]]], features: tuple[int, ...], points: np.ndarray) -> np.ndarray:
    """Partial dependence (as margins) of features at points, by one walk over the nodes: splits by these features are
    followed, all others go both ways by their shares of rows. It costs nodes times points, whatever the number of rows."""
    out = np.zeros(len(points))
    place = {f: k for k, f in enumerate(features)}
    for weight, nodes in trees:
        reached = [(0, np.full(len(points), weight))]
        while reached:
            at, w = reached.pop()
            feature, threshold, left, right, share, prediction = nodes[at]
            if feature == -1:
                out += w * prediction
                continue
            part = (points[:, place[feature]] <= threshold).astype(float) if feature in place else share
            reached += [(left, w * part), (right, w * (1 - part))]
    return out


def knots(filled: DataFrame, columns: list[str], grid: int) -> dict[str, np.ndarray]:
    """Points at which a column's dependence is taken: all its values if they are fewer than grid, else grid evenly
    spaced ones from its 5th to its 95th percentile."""
    long = filled.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "feature", "value").where("value IS NOT NULL AND NOT isnan(value)")
    first = F.row_number().over(Window.partitionBy("feature").orderBy("value"))
    few = long.distinct().withColumn("_n", first).where(F.col("_n") <= grid).groupBy("feature").agg(F.array_sort(F.collect_list("value")).alias("v"))
    ends = {r["feature"]: r["q"] for r in quantiles(long, ["feature"], "value", (0.05, 0.95)).collect()}
    return {r["feature"]: np.array(r["v"]) if len(r["v"]) < grid else np.linspace(*ends[r["feature"]], grid) for r in few.collect()}


def interaction_strengths(model, df: DataFrame, columns: list[str], grid: int = 16, top: int | None = None) -> list[tuple[str, str, float]]:
    """Friedman's H squared of every pair of numeric columns of a model of boosted trees, largest first: the share of the
    joint partial dependence's variance that the two single ones don't explain, all centred over the grid.

    model: a fitted ``pipeline`` of trees. Rows are read for the knots only."""
    filled = [f"{c}_filled" for c in columns]
    imputer, assembler, trees = model.stages[0], next(s for s in model.stages if isinstance(s, VectorAssembler)), tree_nodes(model.stages[-1])
    at = knots(imputer.transform(df), filled, grid)
    index = {c: assembler.getInputCols().index(c) for c in filled}
    single = {}
    for c in filled:
        d = dependence(trees, (index[c],), at[c][:, None])
        single[c] = d - d.mean()
    out = []
    for a, b in combinations(filled, 2):
        points = np.array(np.meshgrid(at[a], at[b], indexing="ij")).reshape(2, -1).T
        joint = dependence(trees, (index[a], index[b]), points).reshape(len(at[a]), -1)
        joint = joint - joint.mean()
        total = float((joint**2).sum())
        rest = float(((joint - single[a][:, None] - single[b]) ** 2).sum())
        out.append((a.removesuffix("_filled"), b.removesuffix("_filled"), rest / total if total > 1e-18 else 0.0))
    return sorted(out, key=lambda x: (-x[2], x[0], x[1]))[:top]

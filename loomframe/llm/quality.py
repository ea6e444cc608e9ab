"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into column expressions."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.common import is_held_out, is_learnable, materialize, release, shared_dir, table, text_or_empty

THRESHOLD = 0.7


def statistics(text: Column) -> dict[str, Column]:
    """Numbers that describe a whole text; all are defined for the empty one."""
    text = text_or_empty(text)
    chars = F.length(text).cast("double")
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    n_words = F.size(words).cast("double")
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / F.greatest(chars, F.lit(1.0))
    return {
        "log_words": F.log2(n_words + 1),
        "chars_per_word": chars / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "marks": share(r"[^\p{L}\p{N}\s.,]"),
        "bars": share(r"\|"),
        "stops": share(r"[.,]"),
        "digits": share("[0-9]"),
        "capitals": share(r"\p{Lu}"),
        "line_feeds": share("\n"),
    }


@dataclass
class RuleModel:
    """Weights of rules, each a tuple of (statistic, "<=" or ">", bound) that must all hold."""

    bias: float = 0.0
    weights: dict[tuple, float] = field(default_factory=dict)

    def score(self, stats: dict[str, Column]) -> Column:
        """The probability of label 1 as one column expression."""
        parts = [F.when(rule_holds(rule, stats), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in self.weights.items()]
        return 1.0 / (1.0 + F.exp(-reduce(Column.__add__, parts, F.lit(self.bias))))


def rule_holds(rule: tuple, stats: dict[str, Column]) -> Column:
    tests = [stats[name] <= bound if sign == "<=" else stats[name] > bound for name, sign, bound in rule]
    return reduce(Column.__and__, tests)


def tree_rules(nodes: list[tuple], names: list[str]) -> set[tuple]:
    """Every path from a root to a node as a conjunction, at most one test a statistic and direction.

    nodes: (tree, node, left child, right child, feature, bound) of each tree's nodes; a leaf's children are -1.
    """
    by = {(tree, node): rest for tree, node, *rest in nodes}
    rules, open_paths = set(), [(tree, 0, ()) for tree in {t for t, _ in by}]
    while open_paths:
        tree, node, path = open_paths.pop()
        left, right, feature, bound = by[tree, node]
        if left < 0:
            continue
        for child, sign in ((left, "<="), (right, ">")):
            longer = (*path, (names[feature], sign, bound))
            tightest: dict[tuple, float] = {}
            for name, side, b in longer:
                tightest[name, side] = (min if side == "<=" else max)(b, tightest.get((name, side), b))
            rules.add(tuple(sorted((n, s, b) for (n, s), b in tightest.items())))
            open_paths.append((tree, child, longer))
    return rules


def forest_nodes(forest: RandomForestClassificationModel, spark: SparkSession) -> list[tuple]:
    """A forest's nodes as (tree, node, left child, right child, feature, bound), from the table that it is saved as: a few hundred rows."""
    path = f"{shared_dir(spark)}/quality-forest-{uuid.uuid4().hex}"
    forest.write().save(path)
    n = "nodeData"
    saved = spark.read.parquet(f"{path}/data").select(
        "treeID", f"{n}.id", f"{n}.leftChild", f"{n}.rightChild", f"{n}.split.featureIndex", F.get(f"{n}.split.leftCategoriesOrThreshold", F.lit(0))
    )
    return [tuple(r) for r in saved.collect()]


def fit_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_train_rows: int = 12_000,
    n_trees: int = 12,
    depth: int = 3,
    penalty: float = 0.002,
    seed: int = 7,
) -> RuleModel:
    """Fit on about ``max_train_rows`` learnable labelled rows, chosen by a hash of their ids.

    A random forest gives the paths; lasso logistic regression weighs them and drops most. An id with several labels
    takes their majority (ties: 1). Without labels the score is 0.5; with one class it is 0.01 or 0.99.
    """
    marks = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
        .where(is_learnable(F.col("id")) & F.col("y").isNotNull())
        .groupBy("id")
        .agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    )
    share = max_train_rows / max(1, marks.count())
    chosen = marks.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30))
    stats = statistics(F.col("text"))
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    train = materialize(joined.select("y", *[c.alias(n) for n, c in stats.items()]), "quality-train")
    n, positive = train.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not n:
        return RuleModel()
    if positive in (0, n):
        return RuleModel(bias=4.6 if positive else -4.6)
    names = list(stats)
    features = train.select("y", array_to_vector(F.array(*names)).alias("features"))
    forest = RandomForestClassifier(
        labelCol="y", numTrees=n_trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", minInstancesPerNode=20
    ).fit(features)
    own = {name: F.col(name) for name in names}
    rules = sorted(tree_rules(forest_nodes(forest, docs.sparkSession), names))
    if not rules:
        return RuleModel(bias=0.0)
    held = train.select("y", array_to_vector(F.array(*[rule_holds(r, own).cast("double") for r in rules])).alias("features"))
    held = materialize(held, "quality-rules")
    fit = LogisticRegression(labelCol="y", elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60).fit(held)
    release(train, held)
    return RuleModel(fit.intercept, {r: float(w) for r, w in zip(rules, fit.coefficients.toArray()) if w})


def score_quality(docs: DataFrame, model: RuleModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` plus ``quality_score`` (0 to 1) and ``quality_predicted`` (int); null texts count as empty.

    Only column expressions over the whole text run here. Columns of these names are replaced.
    """
    rest = docs.drop("quality_score", "quality_predicted")
    stats = statistics(F.col(text_col))
    described = rest.withColumn("__loomframe_stats", F.struct(*[c.alias(n) for n, c in stats.items()]))
    scored = described.withColumn("quality_score", model.score({n: F.col("__loomframe_stats")[n] for n in stats}))
    predicted = (F.col("quality_score") >= threshold).cast("int").alias("quality_predicted")
    return scored.select(*rest.columns, "quality_score", predicted)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from three of four folds of ``labels``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_rules(docs, table(spark, sf_dir, "labels"))
    found = score_quality(docs, model)
    held_out = is_held_out(F.col("doc_id")).alias("held_out")
    return found.select("doc_id", held_out, F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))

"""Guarded model training: task detection, refusals, splits in order of time, exact metrics, leakage and baselines.

Candidates come from Spark's own library. Metrics are exact aggregates; the decision whether a model is useful is taken
against what a constant prediction reaches, with room for chance.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenta.functions.stats import auc_error
from lumenta.sources.durable import durable, running

LEAST_ROWS, LEAST_CLASS, MOST_LEVELS, LEAK_AUC, TRAIN_SHARE, RARE = 200, 20, 50, 0.98, 0.75, 0.01


class NotTrainable(ValueError):
    pass


def task(frame: DataFrame, target: str) -> DataFrame:
    """n_values, task: binary for two values, regression for a number with more than twenty, else refused."""
    number = isinstance(frame.schema[target].dataType, T.NumericType)
    n = F.countDistinct(target)
    return frame.agg(n.alias("n_values"), F.when(n == 2, "binary").when(F.lit(number) & (n > 20), "regression").otherwise("refused").alias("task"))


def guards(frame: DataFrame, target: str) -> DataFrame:
    """n_rows, least_class, enough_rows, enough_of_each: over rows with a target."""
    counts = frame.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("n"))
    out = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.min("n"), F.lit(0)).alias("least_class"))
    return out.select("n_rows", "least_class", (F.col("n_rows") >= LEAST_ROWS).alias("enough_rows"), (F.col("least_class") >= LEAST_CLASS).alias("enough_of_each"))


def features(frame: DataFrame, target: str, skip: tuple[str, ...] = ()) -> tuple[list[str], list[str], list[str]]:
    """(numeric, categorical, dropped): texts of more than fifty values and dates are dropped."""
    names = [f for f in frame.schema if f.name != target and f.name not in skip]
    numeric = [f.name for f in names if isinstance(f.dataType, T.NumericType)]
    text = [f.name for f in names if isinstance(f.dataType, T.StringType | T.BooleanType)]
    levels = frame.agg(*[F.countDistinct(c).alias(c) for c in text]).first() if text else None
    categorical = [c for c in text if levels[c] <= MOST_LEVELS]
    return numeric, categorical, [f.name for f in names if f.name not in numeric and f.name not in categorical]


def temporal_split(frame: DataFrame, order: str, key: str, share: float = TRAIN_SHARE) -> DataFrame:
    """frame with is_train: the first share of rows by order (nulls last; ties by key).

    The row at the cut is found by counting over sorted ranges of order and key alone; the rest is a comparison with it. Rows
    that share order and key stand on the same side.
    """
    n = frame.count()
    last = math.floor(1 + share * (n - 1)) - 1  # rows before the last one to train on
    at = running(frame.select(F.col(order).alias("o"), F.col(key).alias("k")), [F.col("o").asc_nulls_last(), F.col("k").asc_nulls_last()], {"before": F.lit(1)}).where(F.col("before") == last).first()
    if at is None:
        return frame.withColumn("is_train", F.lit(True))
    o, k = F.col(order), F.col(key)
    within = F.lit(True) if at.k is None else k.isNotNull() & (k <= F.lit(at.k))
    if at.o is None:
        return frame.withColumn("is_train", o.isNotNull() | within)
    return frame.withColumn("is_train", o.isNotNull() & ((o < F.lit(at.o)) | (o == F.lit(at.o)) & within))


def stratified_split(frame: DataFrame, target: str, share: float = TRAIN_SHARE, seed: int = 7) -> DataFrame:
    """frame with is_train: of each class the share of its rows, by their places in an order by hash; equal rows are rows of their own."""
    rows = durable(frame.withColumn("__id", F.monotonically_increasing_id()))
    counts = rows.groupBy(F.col(target).alias("__t")).agg(F.count("*").alias("__n"))
    classes = counts.withColumn("__first", F.coalesce(F.sum("__n").over(Window.orderBy("__t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row for each class
    placed = running(rows, [target, F.xxhash64(F.lit(seed), "__id"), "__id"], {"__before": F.lit(1)})
    out = placed.join(F.broadcast(classes), F.col(target).eqNullSafe(F.col("__t")))
    return out.withColumn("is_train", F.col("__before") - F.col("__first") < F.floor(share * F.col("__n") + 0.5)).select(*frame.columns, "is_train")


def baseline(frame: DataFrame, target: str) -> DataFrame:
    """n, prior, brier, accuracy, auc of a constant prediction of a 0/1 target."""
    p = F.avg(F.col(target).cast("double"))
    return frame.agg(F.count(target).alias("n"), p.alias("prior"), (p * (1 - p)).alias("brier"), F.greatest(p, 1 - p).alias("accuracy"), F.lit(0.5).alias("auc"))


def auc(frame: DataFrame, score: str, target: str) -> DataFrame:
    """auc, positives, negatives: exact, by average ranks. Rows are counted by score, and negatives below each score over sorted ranges."""
    counts = frame.where(F.col(score).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(target) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(target) == 1, 0).otherwise(1)).alias("q"))
    wins = running(counts, ["s"], {"below": "q"}).withColumn("w", F.col("p") * (F.col("below") + F.col("q") / 2))
    pos, neg = F.sum("p"), F.sum("q")
    return wins.agg((F.sum("w") / F.nullif((pos * neg).cast("double"), F.lit(0.0))).alias("auc"), pos.alias("positives"), neg.alias("negatives"))


def average_precision(frame: DataFrame, score: str, target: str) -> DataFrame:
    """average_precision: the step sum over distinct scores, from the highest."""
    counts = frame.groupBy(F.col(score).alias("s")).agg(F.sum((F.col(target) == 1).cast("long")).alias("p"), F.count("*").alias("n"))
    run = running(counts, [F.col("s").desc()], {"tp": "p", "seen": "n"})
    tp, seen = F.col("tp") + F.col("p"), F.col("seen") + F.col("n")
    return run.agg((F.sum(F.col("p") * tp / seen) / F.nullif(F.sum("p").cast("double"), F.lit(0.0))).alias("average_precision"))


def brier(frame: DataFrame, score: str, target: str) -> DataFrame:
    e = F.col(score) - F.col(target)
    return frame.agg(F.avg(e * e).alias("brier"), F.avg(F.when((F.col(score) >= 0.5) == (F.col(target) == 1), 1.0).otherwise(0.0)).alias("accuracy"))


def regression_metrics(frame: DataFrame, score: str, target: str) -> DataFrame:
    e = F.col(target) - F.col(score)
    return frame.agg((1 - F.sum(e * e) / F.nullif(F.var_pop(target) * F.count("*"), F.lit(0.0))).alias("r2"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def leakage(frame: DataFrame, columns: list[str], target: str, limit: float = LEAK_AUC) -> DataFrame:
    """feature, auc, leaks: a single feature that orders the target almost perfectly, either way, knows it."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("c")
    counts = frame.where(F.col(target).isNotNull()).select(cells, target).where("c.x is not null").groupBy("c.feature", "c.x").agg(F.sum((F.col(target) == 1).cast("long")).alias("p"), F.sum((F.col(target) != 1).cast("long")).alias("q"))
    run = running(counts, ["feature", "x"], {"below": "q"})
    first = run.groupBy("feature").agg(F.min("below").alias("first"))  # negatives of the features before: one row for each feature
    wins = run.join(F.broadcast(first), "feature").withColumn("w", F.col("p") * (F.col("below") - F.col("first") + F.col("q") / 2))
    out = wins.groupBy("feature").agg((F.sum("w") / F.nullif((F.sum("p") * F.sum("q")).cast("double"), F.lit(0.0))).alias("auc"))
    return out.withColumn("leaks", F.coalesce(F.greatest(F.col("auc"), 1 - F.col("auc")) >= limit, F.lit(False)))


def beats(auc_value: float, positives: int, negatives: int) -> bool:
    """Over chance by 0.02 and by two standard errors."""
    return auc_value - 0.5 > max(0.02, 2 * auc_error(auc_value, positives, negatives))


@dataclass
class Training:
    task: str
    model: str | None = None
    useful: bool = False
    metrics: dict = field(default_factory=dict)
    baseline: dict = field(default_factory=dict)
    leaks: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    importances: list[tuple[str, float]] = field(default_factory=list)
    refused: str | None = None

    def record(self) -> dict:
        return asdict(self)


def _rare_pooled(train: DataFrame, column: str):
    """Levels that at least a hundredth of the training rows have; at most MOST_LEVELS."""
    n = train.count()
    return [r[0] for r in train.groupBy(column).count().where(F.col("count") >= RARE * n).select(column).dropna().collect()]


def _pipeline(train: DataFrame, numeric: list[str], categorical: list[str]):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler

    stages, parts = [], []
    if numeric:
        stages += [Imputer(strategy="median", inputCols=numeric, outputCols=[f"__i_{c}" for c in numeric]), VectorAssembler(inputCols=[f"__i_{c}" for c in numeric], outputCol="__num"), StandardScaler(withMean=True, inputCol="__num", outputCol="__scaled")]
        parts.append("__scaled")
    for c in categorical:
        stages += [StringIndexer(inputCol=f"__c_{c}", outputCol=f"__x_{c}", handleInvalid="keep"), OneHotEncoder(inputCol=f"__x_{c}", outputCol=f"__o_{c}")]
        parts.append(f"__o_{c}")
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=parts, outputCol="__features")])


def train(frame: DataFrame, target: str, order: str | None = None, key: str | None = None, skip: tuple[str, ...] = (), trees: int = 200, seed: int = 7) -> Training:
    """The best of a few candidates on held-out rows, or why there is none. With an order column the last quarter is held out."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    rows = frame.where(F.col(target).isNotNull())
    kind = task(rows, target).first().task
    if kind == "refused":
        return Training("refused", refused="the target has neither two values nor a wide range of numbers")
    g = guards(rows, target).first()
    if not g.enough_rows or kind == "binary" and not g.enough_of_each:
        return Training(kind, refused=f"fewer than {LEAST_ROWS} rows or {LEAST_CLASS} of a class")
    numeric, categorical, dropped = features(rows, target, tuple(x for x in (*skip, order, key) if x))
    if not numeric and not categorical:
        return Training(kind, dropped=dropped, refused="no usable features")
    out = Training(kind, dropped=dropped)
    split = temporal_split(rows, order, key or order) if order else stratified_split(rows, target)
    if kind == "binary":
        high = rows.agg(F.max(target)).first()[0]
        split = split.withColumn("__y", (F.col(target) == F.lit(high)).cast("double"))
    else:
        split = split.withColumn("__y", F.col(target).cast("double"))
    split = split.withColumns({c: F.col(c).cast("double") for c in numeric})
    fitted = split.where("is_train")
    for c in categorical:
        known = _rare_pooled(fitted, c)
        split = split.withColumn(f"__c_{c}", F.when(F.col(c).cast("string").isin([str(k) for k in known]), F.col(c).cast("string")).otherwise("other"))
    prep = _pipeline(split.where("is_train"), numeric, categorical).fit(split.where("is_train"))
    ready = prep.transform(split)
    p = ready.where("is_train").agg(F.avg("__y")).first()[0]
    ready = ready.withColumn("__w", F.when(F.col("__y") == 1, 0.5 / max(p, 1e-9)).otherwise(0.5 / max(1 - p, 1e-9)) if kind == "binary" else F.lit(1.0)).cache()
    fit, test = ready.where("is_train"), ready.where(~F.col("is_train"))
    own = {"featuresCol": "__features", "labelCol": "__y"}
    if kind == "binary":
        candidates = {"logistic": LogisticRegression(weightCol="__w", regParam=0.01, **own), "random_forest": RandomForestClassifier(numTrees=trees, minInstancesPerNode=5, seed=seed, weightCol="__w", **own), "gradient_boosting": GBTClassifier(maxIter=20, seed=seed, **own)}
        b = baseline(test, "__y").first()
        out.baseline = {"brier": b.brier, "accuracy": b.accuracy, "auc": 0.5}
        out.leaks = [r.feature for r in leakage(test, numeric, "__y").where("leaks").collect()] if numeric else []
    else:
        candidates = {"ridge": LinearRegression(regParam=0.1, elasticNetParam=0.0, **own), "random_forest": RandomForestRegressor(numTrees=trees, minInstancesPerNode=5, seed=seed, **own), "gradient_boosting": GBTRegressor(maxIter=20, seed=seed, **own)}
        mean = fit.agg(F.avg("__y")).first()[0]
        out.baseline = regression_metrics(test.withColumn("__s", F.lit(mean)), "__s", "__y").first().asDict()
    best, best_model = None, None
    for name, model in candidates.items():
        made = model.fit(fit)
        scored = made.transform(test).withColumn("__s", vector_to_array("probability")[1] if kind == "binary" else F.col("prediction"))
        if kind == "binary":
            a = auc(scored, "__s", "__y").first()
            m = {"auc": a.auc, **brier(scored, "__s", "__y").first().asDict(), **average_precision(scored, "__s", "__y").first().asDict()}
            value = a.auc if a.auc is not None else 0.0
            useful = a.auc is not None and beats(a.auc, a.positives, a.negatives)
        else:
            m = regression_metrics(scored, "__s", "__y").first().asDict()
            value, useful = m["r2"] if m["r2"] is not None else -1e9, m["rmse"] < out.baseline["rmse"] * 0.98
        # of models within a hundredth of each other the better calibrated one
        if best is None or value > best[0] + 0.01 or value > best[0] - 0.01 and m.get("brier", 0) < best[2].get("brier", 0):
            best, best_model = (value, name, m, useful), made
    _, out.model, out.metrics, out.useful = best
    if out.leaks:
        out.useful = False
    out.importances = importances(prep, best_model, split.where(~F.col("is_train")), [*numeric], [*categorical], kind)
    ready.unpersist()
    return out


def importances(prep, model, test: DataFrame, numeric: list[str], categorical: list[str], kind: str, seed: int = 7, repeats: int = 5, most: int = 15) -> list[tuple[str, float]]:
    """How much the mean squared error grows when one feature's values are dealt anew among the held-out rows, in the mean of some deals.

    Rows get places in an order by hash; a deal gives each row the value that stands some places further round.
    """
    from pyspark.ml.functions import vector_to_array

    def error(rows: DataFrame) -> float:
        s = model.transform(prep.transform(rows)).withColumn("__s", vector_to_array("probability")[1] if kind == "binary" else F.col("prediction"))
        return s.agg(F.avg(F.pow(F.col("__s") - F.col("__y"), 2))).first()[0]

    n, base, out = test.count(), error(test), []
    if n < 2:
        return []
    rows = durable(test.withColumn("__id", F.monotonically_increasing_id()))
    at = durable(running(rows, [F.xxhash64(F.lit(seed), "__id"), "__id"], {"__r": F.lit(1)}))
    shifts = [1 + (seed * 7919 + k * 104729) % (n - 1) for k in range(repeats)]
    for c in [*numeric, *[f"__c_{x}" for x in categorical]]:
        dealt = at.select(F.col(c).alias("__v"), F.col("__r").alias("__from"), F.explode(F.array(*[F.lit(s) for s in shifts])).alias("__shift")).select("__v", F.pmod(F.col("__from") + F.col("__shift"), F.lit(n)).alias("__r"))
        out.append((c.removeprefix("__c_"), error(at.drop(c).join(dealt, "__r").withColumnRenamed("__v", c)) - base))
    return sorted(out, key=lambda x: -x[1])[:most]

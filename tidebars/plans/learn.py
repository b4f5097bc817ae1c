"""Models over bars: scaling, windows for supervised learning, clusters, trees, and what predictions are worth.

Fitting goes through the ML library.
"""

from __future__ import annotations

from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.functions.frames import before, ordered, rows, safe

# --- features


def scale(table: DataFrame, columns: list[str], kind: str = "standard") -> DataFrame:
    """columns scaled: "standard" by mean and population deviation, "minmax" into 0 to 1, "maxabs" by the largest size.
    Without spread a column becomes 0. One aggregation gives the constants, a row that is broadcast."""
    low = {"standard": F.avg, "minmax": F.min, "maxabs": lambda c: F.max(F.lit(0.0))}[kind]
    width = {"standard": F.stddev_pop, "minmax": lambda c: F.max(c) - F.min(c), "maxabs": lambda c: F.max(F.abs(c))}[kind]
    one = table.agg(*[low(F.col(c)).alias(f"__l_{c}") for c in columns], *[width(F.col(c)).alias(f"__w_{c}") for c in columns])
    joined = table.join(F.broadcast(one), how="cross")
    return joined.withColumns({c: F.when(F.col(c).isNotNull(), F.coalesce(safe(F.col(c) - F.col(f"__l_{c}"), F.col(f"__w_{c}")), F.lit(0.0))) for c in columns}).select(*table.columns)


def supervised(bars: DataFrame, look_back: int = 5, columns: tuple[str, ...] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """For each window of look_back bars: the columns of all but the last as <column>_day<k> (0 oldest), and of the last
    predicted_high, predicted_low and prediction (their middle). The windows that end with a symbol's last two bars are left out."""
    old = {f"{c}_day{k}": before(c, look_back - 1 - k) for k in range(look_back - 1) for c in columns}
    df = bars.withColumns({"first_ts": before("ts", look_back - 1), "__later": F.lead("ts", 2).over(ordered()), **old})
    return df.where("first_ts is not null and __later is not null").select("symbol", "ts", "first_ts", *old, F.col("high").alias("predicted_high"), F.col("low").alias("predicted_low"), ((F.col("high") + F.col("low")) / 2).alias("prediction"))


def sequences(bars: DataFrame, columns: list[str], n: int, label: str) -> DataFrame:
    """The last n rows of columns as one array (row after row), and the next row's label; only full ones with a label."""
    w = rows(-(n - 1))
    parts = F.flatten(F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).over(w))
    out = bars.withColumns({"sequence": parts, "next_label": F.lead(label).over(ordered()), "__n": F.count("*").over(w)})
    return out.where((F.col("__n") == n) & F.col("next_label").isNotNull()).select("symbol", "ts", "sequence", "next_label")


def vectors(table: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    """table with its columns as one vector; rows with a null or NaN among them are left out."""
    return VectorAssembler(inputCols=columns, outputCol=name, handleInvalid="skip").transform(table)


def principal(table: DataFrame, columns: list[str], k: int = 2) -> tuple[DataFrame, list[float]]:
    """Scores pc_1 to pc_k of each row on the leading components, and the share of variance of each."""
    centred = vectors(scale(table, columns), columns, "__x")
    model = PCA(k=k, inputCol="__x", outputCol="__pc").fit(centred)
    out = model.transform(centred).withColumn("__a", vector_to_array("__pc"))
    return out.select(*table.columns, *[F.col("__a")[i].alias(f"pc_{i + 1}") for i in range(k)]), model.explainedVariance.toArray().tolist()


# --- clusters and states


def clusters(table: DataFrame, columns: list[str], k: int, kind: str = "kmeans", seed: int = 1) -> DataFrame:
    """table with `cluster` of standardised columns, by k-means or a Gaussian mixture; numbers go up with the first column's mean."""
    ready = vectors(scale(table, columns), columns, "__x")
    maker = KMeans(k=k, seed=seed, featuresCol="__x", predictionCol="__c", initSteps=5) if kind == "kmeans" else GaussianMixture(k=k, seed=seed, featuresCol="__x", predictionCol="__c", probabilityCol="__p")
    found = maker.fit(ready).transform(ready)
    means = {r["__c"]: r["m"] for r in found.groupBy("__c").agg(F.avg(columns[0]).alias("m")).collect()}
    order = {c: i for i, c in enumerate(sorted(means, key=lambda c: (means[c], c)))}
    number = F.element_at(F.create_map(*[F.lit(x) for pair in order.items() for x in pair]), F.col("__c"))
    return found.withColumn("cluster", number).select(*table.columns, "cluster")


def silhouettes(table: DataFrame, columns: list[str], most: int = 6, seed: int = 1) -> DataFrame:
    """The silhouette of k-means for each number of clusters from 2 on."""
    ready = vectors(scale(table, columns), columns, "__x").select("__x")
    judge = ClusteringEvaluator(featuresCol="__x", predictionCol="__c")
    out = [(k, float(judge.evaluate(KMeans(k=k, seed=seed, featuresCol="__x", predictionCol="__c").fit(ready).transform(ready)))) for k in range(2, most + 1)]
    return table.sparkSession.createDataFrame(out, "k int, silhouette double")


def name_clusters(table: DataFrame, label: str) -> DataFrame:
    """A name for each label by its means: table needs rsi, momentum and adx."""
    m = table.groupBy(label).agg(F.avg("rsi").alias("rsi"), F.avg("momentum").alias("momentum"), F.avg("adx").alias("adx"), F.count("*").alias("n"))
    up = (F.col("rsi") > 50) & (F.col("momentum") > 0)
    down = (F.col("rsi") < 50) & (F.col("momentum") < 0)
    return m.withColumn("name", F.when(up & (F.col("adx") > 25), "strong_up").when(up, "up").when(down & (F.col("adx") > 25), "strong_down").when(down, "down").otherwise("sideways"))


# --- forecasts


def trees(train: DataFrame, test: DataFrame, columns: list[str], target: str, kind: str = "forest", seed: int = 1) -> DataFrame:
    """test with `predicted` of a forest or of boosted trees that were fitted on train."""
    maker = RandomForestRegressor(featuresCol="__x", labelCol=target, predictionCol="predicted", numTrees=30, maxDepth=6, seed=seed) if kind == "forest" else GBTRegressor(featuresCol="__x", labelCol=target, predictionCol="predicted", maxIter=20, maxDepth=4, seed=seed)
    model = maker.fit(vectors(train.where(F.col(target).isNotNull()), columns, "__x"))
    return model.transform(vectors(test, columns, "__x")).drop("__x")


def line_beyond(bars: DataFrame, x: str, extra: int) -> DataFrame:
    """The least-squares line through each symbol's whole history of x, by row, and `extra` rows beyond it."""
    numbered = bars.withColumn("__i", (F.row_number().over(ordered()) - 1).cast("double"))
    fit = numbered.groupBy("symbol").agg(F.regr_slope(x, "__i").alias("slope"), F.regr_intercept(x, "__i").alias("start"), F.count("*").alias("n"))
    each = fit.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") + extra - 1)))
    return each.select("symbol", "row", (F.col("start") + F.col("slope") * F.col("row")).alias("fitted"), (F.col("row") >= F.col("n")).alias("beyond"))


def autoregressive(bars: DataFrame, x: str = "close") -> DataFrame:
    """Each bar's x forecast from the one before by a line per symbol, fitted over all its pairs."""
    df = bars.withColumn("__was", before(x))
    fit = df.groupBy("symbol").agg(F.regr_slope(x, "__was").alias("__b"), F.regr_intercept(x, "__was").alias("__a"))
    return df.join(F.broadcast(fit), "symbol").withColumn("predicted", F.col("__a") + F.col("__b") * F.col("__was")).drop("__was", "__a", "__b")


# --- metrics


def regression_metrics(table: DataFrame, predicted: str, target: str, season: int = 1) -> DataFrame:
    """Per symbol rmse, mae, mape and smape in percent, mase against the value `season` rows before, and msle."""
    p, t = F.col(predicted), F.col(target)
    df = table.withColumn("__naive", F.abs(t - before(target, season))).where(p.isNotNull() & t.isNotNull())
    out = df.groupBy("symbol").agg(
        F.sqrt(F.avg((p - t) ** 2)).alias("rmse"), F.avg(F.abs(p - t)).alias("mae"), (100 * F.avg(F.abs(safe(p - t, t)))).alias("mape"), (100 * F.avg(safe(2 * F.abs(p - t), F.abs(t) + F.abs(p)))).alias("smape"),
        F.avg("__naive").alias("__n"), F.avg((F.log1p(p) - F.log1p(t)) ** 2).alias("msle"), F.count("*").alias("rows"),
    )
    return out.withColumn("mase", safe(F.col("mae"), F.col("__n"))).drop("__n")


def rises(x: str) -> Column:
    """Whether x is over its value a row before; null on the first row."""
    return F.when(before(x).isNotNull(), F.col(x) > before(x))


def confusion(table: DataFrame, predicted: str, target: str) -> DataFrame:
    """How often each predicted class meets each true one."""
    return table.where(F.col(predicted).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(target).alias("true_class"), F.col(predicted).alias("predicted_class")).agg(F.count("*").alias("n"))


def class_report(table: DataFrame, predicted: str, target: str) -> DataFrame:
    """Precision, recall, F1 and support of each class, and the accuracy over all."""
    pairs = confusion(table, predicted, target)
    sides = pairs.select(F.inline(F.array(F.struct(F.col("true_class").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"), F.when(F.col("true_class") == F.col("predicted_class"), F.col("n")).otherwise(0).alias("right")), F.struct(F.col("predicted_class").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"), F.lit(0).cast("long").alias("right")))))
    each = sides.groupBy("class").agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("right").alias("right"))
    all_ = each.agg((F.sum("right") / F.sum("support")).alias("accuracy"))
    part = {"precision": F.coalesce(safe(F.col("right"), F.col("called")), F.lit(0.0)), "recall": F.coalesce(safe(F.col("right"), F.col("support")), F.lit(0.0))}
    out = each.withColumns(part).withColumn("f1", F.coalesce(safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    return out.join(F.broadcast(all_), how="cross").select("class", "precision", "recall", "f1", "support", "accuracy")


def with_average(metrics: DataFrame, name: str) -> DataFrame:
    """metrics and a row "average" with the mean of each number; name: the column that names rows."""
    numbers = [c for c, kind in metrics.dtypes if c != name]
    return metrics.unionByName(metrics.agg(F.lit("average").alias(name), *[F.avg(c).cast(dict(metrics.dtypes)[c]).alias(c) for c in numbers]))


def chunk_majority(bars: DataFrame, label: str, size: int) -> DataFrame:
    """Each symbol's rows in chunks of `size`: bounds and the commonest label (of equally common ones the least)."""
    df = bars.withColumn("chunk", F.floor((F.row_number().over(ordered()) - 1) / size))
    counts = df.groupBy("symbol", "chunk", label).agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("stop"))
    return counts.groupBy("symbol", "chunk").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(label).alias("x"))).alias("b"), F.min("start").alias("start"), F.max("stop").alias("stop")).select("symbol", "chunk", "start", "stop", F.col("b.x").alias(label))

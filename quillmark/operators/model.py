"""Features, rules, memory, blending, learning and evaluation of the classifier."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tfidf(df: DataFrame, key: str, terms: Column) -> DataFrame:
    """key, term and weight: ``(1 + ln tf) * (ln((1 + N) / (1 + df)) + 1)``, of unit length for each key."""
    tf = df.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    n = df.agg(F.count("*").alias("n"))
    found = tf.groupBy("term").agg(F.count("*").alias("df"))
    raw = tf.join(found, "term").crossJoin(F.broadcast(n)).select(key, "term", ((1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))  # one row
    length = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return raw.join(length, key).select(key, "term", (F.col("w") / F.col("length")).alias("weight"))


def memory(df: DataFrame, key: str, label: str) -> DataFrame:
    """For each key the share of each of its labels."""
    pairs = df.groupBy(key, label).agg(F.count("*").alias("n"))
    whole = pairs.groupBy(key).agg(F.sum("n").alias("whole"))
    return pairs.join(whole, key).select(key, label, F.round(F.col("n") / F.col("whole"), 6).alias("share"))


def blend(semantic: Column, lexical: Column, rules: Column, remembered: Column) -> Column:
    """Scores by category: 3 : 1, then 7 : 3 with rules that fired, then halves with what is remembered (null: nothing)."""
    base = F.zip_with(semantic, lexical, lambda s, x: 0.75 * s + 0.25 * x)
    fired = F.exists(rules, lambda r: r > 0)
    ruled = F.when(fired, F.zip_with(base, rules, lambda b, r: 0.7 * b + 0.3 * r)).otherwise(base)
    return F.when(remembered.isNull(), ruled).otherwise(F.zip_with(ruled, remembered, lambda b, m: 0.5 * b + 0.5 * m))


def ranked(scores: Column, n: int = 3) -> Column:
    """The n best (score, index), ties to the higher index."""
    return F.slice(F.reverse(F.array_sort(F.transform(scores, lambda s, i: F.struct(s.alias("score"), i.alias("index"))))), 1, n)


def fold(key: Column, folds: int = 5) -> Column:
    """A fold that keeps a group together, by the digest of its key."""
    return (F.conv(F.substring(F.sha1(key), 1, 6), 16, 10).cast("int") % folds).cast("int")


def confusion_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """support, precision, recall and F1 of each class (0 where undefined), by one pass of counts."""
    both = df.select(F.explode(F.array(F.struct(F.col(actual).alias("c"), F.lit(1).alias("a"), F.lit(0).alias("p"), (F.col(actual) == F.col(predicted)).cast("int").alias("t")), F.struct(F.col(predicted).alias("c"), F.lit(0).alias("a"), F.lit(1).alias("p"), F.lit(0).alias("t")))).alias("e")).select("e.*")
    sums = both.groupBy(F.col("c").alias("class")).agg(F.sum("a").alias("support"), F.sum("p").alias("guessed"), F.sum("t").alias("hit"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0)))
    return sums.select("class", "support", F.round(ratio(F.col("hit"), F.col("guessed")), 6).alias("precision"), F.round(ratio(F.col("hit"), F.col("support")), 6).alias("recall"), F.round(ratio(2 * F.col("hit"), F.col("support") + F.col("guessed")), 6).alias("f1"))


def band(p: Column) -> Column:
    return F.when(p >= 0.9, "0.90+").when(p >= 0.75, "0.75-0.90").when(p >= 0.5, "0.50-0.75").otherwise("below 0.50")


def reliability(df: DataFrame, p: str, hit: str) -> DataFrame:
    """For each band of confidence its rows, their share and how often they were right."""
    sums = df.groupBy(band(F.col(p)).alias("band")).agg(F.count("*").alias("n"), F.round(F.avg(F.col(hit).cast("double")), 6).alias("accuracy"))
    whole = sums.agg(F.sum("n").alias("whole"))
    return sums.crossJoin(F.broadcast(whole)).select("band", "n", "accuracy", F.round(F.col("n") / F.col("whole"), 6).alias("share"))  # one row


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights: rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("rows"), F.count("*").alias("classes"))
    return counts.crossJoin(F.broadcast(whole)).select(label, "n", F.round(F.col("rows") / (F.col("classes") * F.col("n")), 6).alias("weight"))  # one row


def balanced_fit(rows: DataFrame, c: float, tolerance: float = 1e-9, rounds: int = 200) -> LogisticRegressionModel:
    """Multinomial regression of features and label, classes weighted alike, with penalty ``|w|**2 / (2 c)``."""
    weighted = rows.join(F.broadcast(class_weights(rows, "label").select("label", "weight")), "label")  # a row for each class
    whole = weighted.agg(F.sum("weight")).first()[0]
    return LogisticRegression(family="multinomial", weightCol="weight", regParam=1 / (c * whole), elasticNetParam=0.0, standardization=False, maxIter=rounds, tol=tolerance).fit(weighted)


def softmax_fit(df: DataFrame, vector: str, label: str, c: float) -> LogisticRegressionModel:
    """``balanced_fit`` on a column of arrays."""
    return balanced_fit(df.select(array_to_vector(vector).alias("features"), F.col(label).cast("double").alias("label")), c)


def softmax_scores(model: LogisticRegressionModel, df: DataFrame, vector: str) -> DataFrame:
    return model.transform(df.withColumn("features", array_to_vector(vector))).withColumn("scores", vector_to_array("probability")).drop("features", "rawPrediction", "probability", "prediction")


def calibration_features(top: Column, second: Column, eps: float = 1e-4) -> list[Column]:
    """The log odds of the best score, its lead over the second in log odds, and in score."""
    odds = lambda p: F.log((p + eps) / (1 - p + eps))
    return [odds(top), odds(top) - odds(second), top - second]


def calibrated(features: list[Column], mean: list[float], deviation: list[float], weights: list[float], intercept: float) -> Column:
    z = sum(((f - m) / d * w for f, m, d, w in zip(features, mean, deviation, weights, strict=True)), F.lit(intercept))
    return 1 / (1 + F.exp(-z))


def agreed(c: Column, a: Column, same: Column) -> Column:
    """Two engines' certainty: more than either's if they agree, a little less than the second's if not."""
    return F.when(same, F.greatest(c, a, 1 - (1 - c) * (1 - a))).otherwise(a * 0.9)

"""The classifier's answer for each ad: model scores, rules and advertiser memory put together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import keywords, text
from quillmark.operators import model

REVIEW_BELOW = 0.35


def memory_shares(rows: DataFrame, key: str, label: str, categories: list[str]) -> DataFrame:
    """(memory_key, remembered): for each key the shares of all categories, in their order; other labels are left out."""
    counts = rows.where(F.col(label).isin(*categories) & F.col(key).isNotNull()).groupBy(F.col(key).alias("memory_key")).agg(F.count("*").alias("whole"), *[F.count_if(F.col(label) == c).alias(f"c{i}") for i, c in enumerate(categories)])
    return counts.select("memory_key", F.array(*[F.col(f"c{i}") / F.col("whole") for i in range(len(categories))]).alias("remembered"))


def remember(memory: DataFrame, corrections: DataFrame, categories: list[str]) -> DataFrame:
    """The memory after corrections (memory_key, category, ts): each key has the last one's category alone; ties in ts go to the later name."""
    last = corrections.groupBy("memory_key").agg(F.max(F.struct("ts", "category")).alias("c"))
    only = last.select("memory_key", F.array(*[(F.col("c.category") == c).cast("int").cast("double") for c in categories]).alias("remembered"))
    return memory.join(only.select("memory_key"), "memory_key", "left_anti").unionByName(only)


def answer(body: Column, lexical: Column, semantic: Column, hits: Column, remembered: Column, categories: list[str], certainty=None, fallback: str = "Sponsored Stories", digits: int = 3) -> Column:
    """The answer as a struct: best three, how it came about, and whether a person should look.

    ``certainty(top, second)`` calibrates the best score; without it the score
    itself counts.  An empty text has the fallback category and no alternatives.
    """
    names = F.array(*map(F.lit, categories))
    rules = keywords.rule_scores(hits, len(categories))
    base = F.when(semantic.isNull(), lexical).otherwise(F.zip_with(semantic, lexical, lambda s, x: 0.75 * s + 0.25 * x))
    ruled = F.when(F.size(hits) > 0, F.zip_with(base, rules, lambda b, r: 0.7 * b + 0.3 * r)).otherwise(base)
    scores = F.when(remembered.isNull(), ruled).otherwise(F.zip_with(ruled, remembered, lambda b, m: 0.5 * b + 0.5 * m))
    method = F.concat_ws("+", F.when(semantic.isNull(), "lexical").otherwise("semantic"), F.when(F.size(hits) > 0, "rules"), F.when(remembered.isNotNull(), "advertiser"))

    def told(best: Column) -> Column:
        top = best[0]["score"]
        second = F.coalesce(F.get(best, 1)["score"], F.lit(0.0))
        return F.struct(
            F.get(names, best[0]["index"]).alias("category"), F.bround(top, digits).alias("confidence"), method.alias("method"), (top < REVIEW_BELOW).alias("needs_review"),
            F.transform(best, lambda b: F.struct(F.get(names, b["index"]).alias("category"), F.bround(b["score"], digits).alias("score"))).alias("alternatives"),
            F.transform(F.filter(hits, lambda e: e["category"] == best[0]["index"]), lambda e: e["keyword"]).alias("matched_keywords"),
            F.bround(certainty(top, second) if certainty else top, digits).alias("certainty"),
        ).cast(f"struct<{_fields()}>")

    full = F.transform(F.array(model.ranked(scores, 3)), told)[0]
    empty = F.struct(F.lit(fallback), F.lit(0.0), F.lit("empty"), F.lit(True), F.array(), F.array(), F.lit(None)).cast(f"struct<{_fields()}>")
    return F.when(F.coalesce(body, F.lit("")) == "", empty).otherwise(full)


def _fields() -> str:
    return "category:string,confidence:double,method:string,needs_review:boolean,alternatives:array<struct<category:string,score:double>>,matched_keywords:array<string>,certainty:double"


def predict_many(ads: DataFrame, lexicon: dict[str, list[str]], memory: DataFrame, networks: list[str], certainty=None, digits: int = 3) -> DataFrame:
    """``ads`` with the answer's columns.

    ``ads`` has title, description, advertiser and domain, the lexical scores and,
    where there is a sentence vector, the semantic ones, both in the order of the
    lexicon's categories.  The memory is joined by the advertiser's key.
    """
    known = memory.select("memory_key", "remembered")
    keyed = read(ads, lexicon).withColumn("memory_key", text.advertiser_key(F.col("domain"), F.col("advertiser"), networks))
    return answered(keyed.join(known, "memory_key", "left"), lexicon, certainty, digits).select(*ads.columns, "answer.*")


def read(ads: DataFrame, lexicon: dict[str, list[str]]) -> DataFrame:
    """``ads`` with what an answer takes from their text: ``said``, empty if there is none, and ``hits``; so joins needn't carry texts."""
    body = text.build_text(F.col("title"), F.col("description"), F.col("advertiser"), F.col("domain"))
    return ads.withColumn("body", body).withColumns({"said": F.substring("body", 1, 1), "hits": keywords.keyword_hits(F.col("body"), lexicon)}).drop("body")


def answered(ads: DataFrame, lexicon: dict[str, list[str]], certainty=None, digits: int = 3) -> DataFrame:
    """``ads`` with ``answer``, from what ``read`` found and their ``lexical``, ``semantic`` and ``remembered`` scores."""
    told = answer(F.col("said"), F.col("lexical"), F.col("semantic"), F.col("hits"), F.col("remembered"), list(lexicon), certainty, digits=digits)
    return ads.withColumn("answer", told)


def standardised(df: DataFrame, columns: list[str], centre=F.avg, least: float = 1e-6) -> DataFrame:
    """The columns less their mean (or another ``centre``, such as ``F.median``), over their population deviation plus ``least``."""
    moments = df.agg(*[centre(c).alias(f"mean_{c}") for c in columns], *[F.stddev_pop(c).alias(f"dev_{c}") for c in columns])
    return df.crossJoin(F.broadcast(moments)).select(*[c for c in df.columns if c not in columns], *[((F.col(c) - F.col(f"mean_{c}")) / (F.col(f"dev_{c}") + least)).alias(c) for c in columns])  # one row


def accuracy_and_f1(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: accuracy, and the mean F1 of all classes that occur, actual or predicted."""
    share = df.agg(F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"))
    macro = model.confusion_metrics(df, actual, predicted).agg(F.avg("f1").alias("macro_f1"))
    return share.crossJoin(F.broadcast(macro)).select(F.round("accuracy", 3).alias("accuracy"), F.round("macro_f1", 3).alias("macro_f1"))  # one row each


@dataclass(frozen=True)
class Calibration:
    """A function of the best two scores to the probability of being right."""

    mean: list[float]
    deviation: list[float]
    weights: list[float]
    intercept: float

    def __call__(self, top: Column, second: Column) -> Column:
        return model.calibrated(model.calibration_features(top, second), self.mean, self.deviation, self.weights, self.intercept)


def fit_calibration(rows: DataFrame, top: str, second: str, right: str, least: int = 50, balanced: bool = True) -> Calibration | None:
    """The calibration by logistic regression; None if rows are few or all alike.

    Right and wrong answers weigh the same in all.  That moves the certainty by
    the log odds of being right; without ``balanced`` it is the share of right answers.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    seen = rows.agg(F.count("*").alias("n"), F.countDistinct(right).alias("kinds")).first()
    if seen["n"] < least or seen["kinds"] < 2:
        return None
    features = [f"f{i}" for i in range(3)]
    raw = rows.select(F.col(right).cast("double").alias("label"), *[f.alias(n) for f, n in zip(model.calibration_features(F.col(top), F.col(second)), features, strict=True)])
    rights = raw.agg(F.sum("label")).first()[0]
    weight = F.when(F.col("label") == 1, seen["n"] / (2 * rights)).otherwise(seen["n"] / (2 * (seen["n"] - rights))) if balanced else F.lit(1.0)
    moments = raw.agg(*[F.avg(f).alias(f) for f in features], *[(F.stddev_pop(f) + 1e-6).alias(f"d{f}") for f in features]).first()
    mean, deviation = [moments[f] for f in features], [moments[f"d{f}"] for f in features]
    scaled = raw.select("label", weight.alias("weight"), array_to_vector(F.array(*[(F.col(f) - m) / d for f, m, d in zip(features, mean, deviation, strict=True)])).alias("features"))
    fit = LogisticRegression(weightCol="weight", regParam=1 / (2 * seen["n"]), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9).fit(scaled)
    return Calibration(mean, deviation, [float(w) for w in fit.coefficients], float(fit.intercept))

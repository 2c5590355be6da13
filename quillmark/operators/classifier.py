"""The classifier as a thing that is trained, stored, loaded and asked.

A stored model is a folder of numbered versions, each with tables for the
lexical model, the memory of advertisers and the regression on vectors, and a
row of settings that is written last: a version without it doesn't count.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text
from quillmark.operators import lexical, model, predict

#: Raised whenever what is stored changes its meaning; another version is fitted anew.
VERSION = 1
AD = ("title", "description", "advertiser", "domain")


@dataclass(frozen=True)
class Settings:
    slots: int = lexical.SLOTS
    #: Slots of the models of the folds, ten of which are fitted at once.
    fold_slots: int = 2**12
    folds: int = 5
    c: float = 8.0
    rounds: int = 200


@dataclass(frozen=True)
class Semantic:
    """Regression on vectors; labels in the order of its classes."""

    regression: LogisticRegressionModel
    labels: list[str]

    def scores(self, rows: DataFrame, vector: str, categories: list[str]) -> DataFrame:
        """``rows`` with ``semantic``: null where there is no vector."""
        width = self.regression.numFeatures
        whole = F.coalesce(F.size(vector) == width, F.lit(False)) & ~F.exists(F.coalesce(vector, F.array().cast("array<double>")), lambda x: x.isNull() | F.isnan(x.cast("double")))
        held = F.when(whole, F.col(vector).cast("array<double>")).otherwise(F.array_repeat(F.lit(0.0), width))
        at = vector_to_array("__probability")
        dense = F.array(*[at[self.labels.index(c)] if c in self.labels else F.lit(0.0) for c in categories])
        asked = rows.withColumns({"__vector": array_to_vector(held), "__whole": whole})
        regression = self.regression.copy().setFeaturesCol("__vector").setProbabilityCol("__probability").setRawPredictionCol("__raw").setPredictionCol("__prediction")
        return regression.transform(asked).withColumn("semantic", F.when(F.col("__whole"), dense)).select(*rows.columns, "semantic")


def training_rows(rows: DataFrame, lexicon: dict[str, list[str]]) -> DataFrame:
    """Rows with a title and a category of the lexicon."""
    return rows.where((text.clean(F.col("title")) != "") & F.col("category").isin(*lexicon))


@dataclass(frozen=True)
class Classifier:
    lexicon: dict[str, list[str]]
    networks: list[str]
    lexical: lexical.Lexical
    semantic: Semantic | None
    memory: DataFrame
    calibration: predict.Calibration | None
    meta: dict

    @property
    def categories(self) -> list[str]:
        return list(self.lexicon)

    def predict_many(self, ads: DataFrame, key: str, vector: str | None = None, digits: int = 3) -> DataFrame:
        """``ads`` (key, title, description, advertiser, domain, perhaps a vector) with the answer's columns.

        Without a vector, a model of vectors or a vector column the lexical
        scores count alone.
        """
        body = text.build_text(*map(F.col, AD))
        scored = self.lexical.scores(ads, key, body, self.categories)
        if self.semantic and vector and vector in ads.columns:
            scored = self.semantic.scores(scored, vector, self.categories)
        else:
            scored = scored.withColumn("semantic", F.lit(None).cast("array<double>"))
        told = predict.predict_many(scored, self.lexicon, self.memory, self.networks, self.calibration, digits)
        return told.drop("lexical", "semantic")

    def remember(self, corrections: DataFrame) -> "Classifier":
        """The classifier after corrections (advertiser, domain, category, ts): an advertiser's last one counts at once."""
        keyed = corrections.select(text.advertiser_key(F.col("domain"), F.col("advertiser"), self.networks).alias("memory_key"), "category", "ts")
        return Classifier(self.lexicon, self.networks, self.lexical, self.semantic, predict.remember(self.memory, keyed, self.categories), self.calibration, self.meta)

    def save(self, folder: str) -> str:
        """Writes the next version; returns its path."""
        spark = self.memory.sparkSession
        number = max(_listed(spark, folder), default=0) + 1
        path = f"{folder.rstrip('/')}/{number}"
        weights = self.lexical.weights
        table = pa.table({"slot": pa.array(np.arange(weights.shape[1]), pa.int64()), "idf": pa.array(np.append(self.lexical.idf, 0.0)), "weights": pa.array(list(weights.T), pa.list_(pa.float64()))})
        spark.createDataFrame(table).write.parquet(f"{path}/lexical")
        self.memory.select("memory_key", "remembered").write.parquet(f"{path}/memory")
        if self.semantic:
            self.semantic.regression.write().save(f"{path}/semantic")
        settings = {
            "version": VERSION, "lexicon": self.lexicon, "networks": self.networks, "labels": self.lexical.labels, "semantic": self.semantic.labels if self.semantic else None,
            "calibration": asdict(self.calibration) if self.calibration else None, "meta": self.meta,
        }
        spark.createDataFrame([(json.dumps(settings),)], "settings string").coalesce(1).write.parquet(f"{path}/settings")
        return path


def _listed(spark: SparkSession, folder: str) -> list[int]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [int(s.getPath().getName()) for s in files.listStatus(path) if s.getPath().getName().isdigit()] if files.exists(path) else []


def read(spark: SparkSession, path: str) -> Classifier:
    """One stored version; an error if it isn't whole or of this VERSION."""
    settings = json.loads(spark.read.parquet(f"{path}/settings").first()["settings"])
    if settings.get("version") != VERSION:
        raise ValueError(f"version {settings.get('version')}, not {VERSION}")
    table = spark.read.parquet(f"{path}/lexical").orderBy("slot").toArrow()  # as many rows as the model has slots
    weights = np.stack(table["weights"].to_pylist()).T
    held = lexical.Lexical(settings["labels"], table["idf"].to_numpy()[:-1], np.ascontiguousarray(weights))
    semantic = Semantic(LogisticRegressionModel.load(f"{path}/semantic"), settings["semantic"]) if settings["semantic"] else None
    calibration = predict.Calibration(**settings["calibration"]) if settings["calibration"] else None
    return Classifier(settings["lexicon"], settings["networks"], held, semantic, spark.read.parquet(f"{path}/memory"), calibration, settings["meta"])


def load(spark: SparkSession, folder: str, fit: Callable[[], Classifier]) -> Classifier:
    """The newest stored version; what ``fit`` gives, stored, if there is none, it is of another VERSION, or it can't be read."""
    try:
        return read(spark, f"{folder.rstrip('/')}/{max(_listed(spark, folder))}")
    except Exception:  # noqa: BLE001 - whatever is wrong with what is stored, the answer is a new model
        fitted = fit()
        fitted.save(folder)
        return fitted


def train(rows: DataFrame, key: str, lexicon: dict[str, list[str]], networks: list[str], feedback: DataFrame | None = None, vector: str | None = None, evaluate: bool = True, settings: Settings = Settings()) -> Classifier:
    """A classifier from rows (key, title, description, advertiser, domain, category, perhaps a vector) and human corrections.

    With ``evaluate`` it is cross-validated, and the answers out of fold
    calibrate the certainty.  The memory knows all rows' advertisers.
    """
    columns = [*AD, "category", *([vector] if vector else [])]
    own = rows.select(F.col(key).cast("string").alias("key"), *columns)
    if feedback is not None:
        extra = feedback.select(F.concat(F.lit("feedback "), F.col(key).cast("string")).alias("key"), *AD, "category")
        own = own.unionByName(extra, allowMissingColumns=True)
    known = training_rows(own, lexicon)
    # the terms of a text are found once, for the model and for the folds' models
    together = settings.slots % settings.fold_slots == 0
    ads = known.select("key", *AD, F.col("category").alias("actual"), F.col("domain").alias("group"))
    terms = lexical.dealt(ads, "key", "group", lexicon, networks, settings.folds, settings.slots, ["key", "actual"])
    held = lexical.fit_terms(terms, "actual", F.array(), 1, settings.slots, settings.slots, settings.c, settings.rounds)[0]
    semantic = None
    if vector:
        whole = known.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"), F.array_position(F.array(*map(F.lit, held.labels)), F.col("category")).alias("n"))
        semantic = Semantic(model.softmax_fit(whole.select("v", (F.col("n") - 1).alias("label")), "v", "label", settings.c), held.labels)
    memory = predict.memory_shares(terms, "memory_key", "actual", list(lexicon))
    counts = {r["actual"]: r["n"] for r in terms.groupBy("actual").agg(F.count("*").alias("n")).collect()}  # a row for each category
    meta: dict = {"rows": sum(counts.values()), "feedback": terms.where(F.col("key").startswith("feedback ")).count(), "class_counts": {c: counts.get(c, 0) for c in lexicon}}
    calibration = None
    if evaluate:
        if together:
            answers = lexical.answers_of_folds(terms, ["actual"], lexicon, settings.folds, settings.slots, settings.fold_slots, settings.rounds)
        else:
            answers = lexical.cross_validated(ads, "key", "group", lexicon, networks, settings.folds, settings.fold_slots, settings.rounds, keep=["actual"])
        answers = answers.select("actual", "category", "known", "alternatives").persist()
        meta["evaluation"] = lexical.validation_report(answers).first().asDict()
        meta["per_class"] = {r["class"]: {k: r[k] for k in ("precision", "recall", "f1", "support")} for r in model.confusion_metrics(answers.where("not known"), "actual", "category").collect()}
        best = answers.select(F.col("alternatives")[0]["score"].alias("top"), F.coalesce(F.get("alternatives", F.lit(1))["score"], F.lit(0.0)).alias("second"), (F.col("category") == F.col("actual")).cast("int").alias("right"))
        calibration = predict.fit_calibration(best.where("top is not null"), "top", "second", "right")
        if calibration:
            certain = best.where("top is not null").select(calibration(F.col("top"), F.col("second")).alias("p"), "right")
            meta["reliability"] = [r.asDict() for r in model.reliability(certain, "p", "right").collect()]
        answers.unpersist()
    return Classifier(lexicon, networks, held, semantic, memory, calibration, meta)

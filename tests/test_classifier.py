"""All folds in one pass, and the classifier's life: trained, stored, loaded, corrected."""

import json
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillmark.operators import classifier, lexical, predict

SLOTS = 128
LEXICON = {"money": ["loan", "home loan"], "fashion": ["shirt", "dress"], "food": ["pizza"]}
WORDS = {"money": "loan credit bank interest emi".split(), "fashion": "shirt shoe dress silk cotton".split(), "food": "pizza cheese rice curry tea".split()}
SCHEMA = "id long, title string, description string, advertiser string, domain string, category string"


def ads(n=90, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        c = list(WORDS)[k % 3]
        title = " ".join([*rng.choice(WORDS[c], 3), *rng.choice(sum(WORDS.values(), []), 2), f"n{rng.integers(9)}"])
        rows.append((k, title, "", f"brand {c}{k // 12}", f"{c}{k // 12}.example", c))
    return rows


def terms(body):
    words = re.findall(r"\w[\w'®]*\w", body.lower())
    grams = [w[i : i + n] for w in (f" {x} " for x in body.lower().split()) for n in range(2, 6) for i in range(len(w) - n + 1)]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])], grams


def slot(term, kind):
    value = xxhash.xxh64(term.encode(), seed=42).intdigest()
    return (value - (value >> 63 << 64)) % SLOTS + kind * SLOTS


def plain_features(bodies, train):
    counts = np.zeros((len(bodies), 2 * SLOTS))
    for i, body in enumerate(bodies):
        for kind, found in enumerate(terms(body)):
            for t in found:
                counts[i, slot(t, kind)] += 1
    df = (counts[train] > 0).sum(axis=0)
    idf = np.where(df > 0, np.log((1 + len(train)) / (1 + df)) + 1, 0)
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    for half in (slice(0, SLOTS), slice(SLOTS, 2 * SLOTS)):
        x[:, half] /= np.maximum(np.linalg.norm(x[:, half], axis=1, keepdims=True), 1e-300)
    return x, idf


def plain_slope(x, y, model, c=8.0):
    """The gradient of the balanced objective at a model's weights; zero where it is least."""
    z = x @ model.weights[:, :-1].T + model.weights[:, -1]
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    k = len(model.labels)
    w = (len(y) / (k * np.bincount(y, minlength=k)))[y]
    g = c * w[:, None] * (p - np.eye(k)[y])
    return np.column_stack([g.T @ x + model.weights[:, :-1], g.sum(axis=0)])


def test_folds_fitted_together_are_those_fitted_apart(spark):
    rows = ads(60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    held = F.array((F.col("id") % 5).cast("int"), (F.floor(F.col("id") / 7) % 5 + 5).cast("int"))
    together = lexical.fit_all(df, F.col("title"), "category", held, 10, SLOTS, tolerance=1e-11, rounds=400)
    bodies, labels = [r[1] for r in rows], sorted(WORDS)
    for m, fitted in enumerate(together):
        train = np.array([k for k in range(60) if (k % 5 != m if m < 5 else k // 7 % 5 + 5 != m)])
        x, idf = plain_features(bodies, train)
        assert fitted.labels == labels and np.allclose(fitted.idf, idf)
        slope = plain_slope(x[train], np.array([labels.index(rows[k][5]) for k in train]), fitted)
        assert np.abs(slope).max() < 0.02, m
    apart = lexical.fit(df.where("id % 5 <> 2"), "id", F.col("title"), "category", SLOTS)
    asked = spark.createDataFrame(rows, SCHEMA)
    one, two = ({r.id: r.lexical for r in fitted.scores(asked, "id", F.col("title"), labels).collect()} for fitted in (apart, together[2]))
    assert max(abs(a - b) for k in one for a, b in zip(one[k], two[k], strict=True)) < 0.01


def test_a_class_that_a_fold_never_sees(spark):
    rows = [(1, "loan bank", "money"), (2, "loan emi", "money"), (3, "shirt silk", "fashion"), (4, "pizza tea", "food")]
    df = spark.createDataFrame(rows, "id long, title string, category string")
    first, second = lexical.fit_all(df, F.col("title"), "category", F.when(F.col("id") == 4, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), 2, SLOTS)
    assert first.labels == ["fashion", "money"] and second.labels == ["fashion", "food", "money"]
    got = first.scores(df, "id", F.col("title"), list(LEXICON)).where("id = 4").first().lexical
    assert got[2] == 0 and abs(sum(got) - 1) < 1e-9


@pytest.fixture(scope="module")
def trained(spark):
    rows = spark.createDataFrame(ads(), SCHEMA).withColumn("v", F.array([F.when(F.col("category") == c, 1.0).otherwise(F.rand(1) * 0.3) for c in WORDS]))
    rows = rows.withColumn("v", F.when(F.col("id") != 5, F.col("v")))
    extra = spark.createDataFrame([(1, "silk saree", "", "Saree House", "saree.example", "fashion"), (2, " ", "", "", "", "food"), (3, "what", "", "", "", "unheard of")], SCHEMA)
    return rows, classifier.train(rows, "id", LEXICON, ["net.com"], extra, "v", settings=classifier.Settings(slots=SLOTS, fold_slots=SLOTS, rounds=60))


def answers(model, rows, vector="v"):
    return {r.id: (r.category, r.confidence, r.method, r.certainty, r.matched_keywords) for r in model.predict_many(rows, "id", vector).collect()}


def test_training_reports_what_it_saw(trained):
    _, model = trained
    assert model.meta["rows"] == 91 and model.meta["feedback"] == 1 and model.meta["class_counts"] == {"money": 30, "fashion": 31, "food": 30}
    assert model.meta["evaluation"]["accuracy"] > 0.8 and model.meta["evaluation"]["known_accuracy"] >= model.meta["evaluation"]["accuracy"] - 0.1
    assert set(model.meta["per_class"]) == set(LEXICON) and sum(r["n"] for r in model.meta["reliability"]) == 182
    assert model.calibration is not None and json.loads(json.dumps(model.meta)) == model.meta


def test_answers_are_the_same_after_loading(spark, trained, tmp_path):
    rows, model = trained
    folder = str(tmp_path / "models")
    before = answers(model, rows)
    assert before[0][0] == "money" and before[0][2].startswith("semantic") and before[5][2].startswith("lexical") and "advertiser" in before[0][2]

    def never():
        raise AssertionError("was stored")

    model.save(folder)
    loaded = classifier.load(spark, folder, never)
    assert answers(loaded, rows) == before and loaded.meta == model.meta
    assert all(m.startswith("lexical") for _, _, m, *_ in answers(loaded, rows.drop("v")).values())  # degrades without vectors
    new = spark.createDataFrame([(1, "something", "", "Saree House", "saree.example", None), (2, "something", "", "x", "net.com", None)], SCHEMA).drop("category")
    fixed = loaded.remember(spark.createDataFrame([("x", "net.com", "food", 1), ("x", "net.com", "money", 2)], "advertiser string, domain string, category string, ts long"))
    assert answers(fixed, new)[2][0] == "money" and "advertiser" in answers(fixed, new)[2][2] and "advertiser" not in answers(loaded, new)[2][2]
    fixed.save(folder)
    assert answers(classifier.load(spark, folder, never), new) == answers(fixed, new)


@pytest.mark.parametrize("harm", ["version", "half", "broken", "missing"])
def test_what_cannot_be_read_is_fitted_anew(spark, trained, tmp_path, monkeypatch, harm):
    rows, model = trained
    folder, asked = tmp_path / "models", []

    def again():
        asked.append(1)
        return model

    if harm == "version":
        with monkeypatch.context() as m:
            m.setattr(classifier, "VERSION", 0)
            model.save(str(folder))
    elif harm != "missing":
        model.save(str(folder))
        for part in (folder / "1" / ("settings" if harm == "half" else "lexical")).glob("*.parquet"):
            part.write_bytes(b"") if harm == "broken" else part.unlink()
        for crc in (folder / "1" / "lexical").glob(".*.crc"):
            crc.unlink()
    assert classifier.load(spark, str(folder), again) is model and asked == [1]
    assert classifier.load(spark, str(folder), again).meta == model.meta and asked == [1]  # it was stored


def test_calibration_is_kept_as_numbers(spark):
    kept = predict.Calibration([0.1, 0.2, 0.3], [1.0, 1.0, 1.0], [1.0, 0.5, 0.2], 0.1)
    p = spark.range(1).select(kept(F.lit(0.9), F.lit(0.05))).first()[0]
    f = [np.log(0.9001 / 0.1001), np.log(0.9001 / 0.1001) - np.log(0.0501 / 0.9501), 0.85]
    assert abs(p - 1 / (1 + np.exp(-(0.1 + sum((a - m) * w for a, m, w in zip(f, [0.1, 0.2, 0.3], [1.0, 0.5, 0.2], strict=True)))))) < 1e-12


def test_terms_are_packed_and_folded(spark):
    texts = ["word " * 700 + "été 😀x", "", None, "a bb ccc " + "y" * 60, "word"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, body string").coalesce(1)

    def told(slots):
        held = lexical.prepared(rows, [F.col("id")], F.col("body"), slots).orderBy("id").toArrow().combine_chunks().to_batches()[0]
        return lexical._unpacked(held, slots)

    row, slot, times = fine = told(4 * SLOTS)
    assert times.max() >= 700 and set(row) == {0, 3, 4}
    wanted = {}
    for i, body in enumerate(texts):
        for kind, found in enumerate(terms(body or "")):
            for t in found:
                at = (i, slot_in(t, kind, 4 * SLOTS))
                wanted[at] = wanted.get(at, 0) + 1
    assert dict(zip(zip(row.tolist(), slot.tolist()), times.tolist())) == wanted
    for a, b in zip(lexical._folded(fine, 4 * SLOTS, SLOTS), told(SLOTS), strict=True):
        assert (a == b).all()


def slot_in(term, kind, slots):
    value = xxhash.xxh64(term.encode(), seed=42).intdigest()
    return (value - (value >> 63 << 64)) % slots + kind * slots


def test_products_filled_and_not(spark):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    matrix = rng.integers(0, 4, (7, 2 * SLOTS)) * (rng.random((7, 2 * SLOTS)) < 0.2)
    matrix[2], matrix[4, SLOTS:], matrix[5, 3] = 0, 0, 100_000
    row, slot = np.nonzero(matrix)
    batch = pa.RecordBatch.from_arrays(lexical._packed((row, slot, matrix[row, slot]), 7, SLOTS), ["slot", "times", "more", "head"]).slice(1)
    plain = np.where(matrix > 0, 1 + np.log(np.maximum(matrix, 1)), 0)[1:]
    weights, rest = rng.random((2 * SLOTS, 3)), rng.random((6, 2, 3))
    for room in (0, 2**13):
        forth, back = lexical._products(batch, SLOTS, np.zeros(room))
        for h, half in enumerate((slice(0, SLOTS), slice(SLOTS, None))):
            assert np.allclose(forth(weights)[:, h], plain[:, half] @ weights[half])
            assert np.allclose(back(rest)[half], plain[:, half].T @ rest[:, h])


def test_texts_are_read_once_for_all_models(spark, monkeypatch):
    rows, made, prepared = spark.createDataFrame(ads(45), SCHEMA), [], lexical.prepared
    monkeypatch.setattr(lexical, "prepared", lambda *a: made.append(1) or prepared(*a))
    classifier.train(rows, "id", LEXICON, [], settings=classifier.Settings(slots=2 * SLOTS, fold_slots=SLOTS, folds=2, rounds=3))
    assert made == [1]
    kept = lexical.cross_validated(rows.withColumnRenamed("category", "actual"), "id", "domain", LEXICON, [], 2, SLOTS, 3, keep=["id"])
    assert kept.columns[0] == "id" and "title" not in kept.columns and kept.count() == 90

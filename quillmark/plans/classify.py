"""Queries of the classifier: rules at real size, memory, answers, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import keywords, text
from quillmark.operators import classifier as lifecycle
from quillmark.operators import lexical, model, reports
from quillmark.operators import predict as classifier
from quillmark.plans.catalogue import W, query
from quillmark.session import scratch
from quillmark.sources.readers import table

SYLLABLES = "an er in on re th ti ed nd ha en ou es st at he or sh ing ea ble ly al it".split()
BEYOND = ["é", "ñ", "ü", "für", "über", "être en", "él", "ción", "ß", "घर", "गृह कर्ज", "ಸಾಲ"]
#: A lexicon of 10,812 keywords in 21 categories, by rule: two or three syllables in a word, two as a phrase, and some beyond ASCII.
_KEYWORDS = [((i * 25 + j) % 21, a + b) for i, a in enumerate(SYLLABLES) for j, b in enumerate([*SYLLABLES, "ion"])]
_KEYWORDS += [((i * 25 + j + k) % 21, a + b + c) for i, a in enumerate(SYLLABLES) for j, b in enumerate([*SYLLABLES, "ion"]) for k, c in enumerate(SYLLABLES[:16])]
_KEYWORDS += [((i + j) % 21, f"{a} {b}") for i, a in enumerate(SYLLABLES) for j, b in enumerate([*SYLLABLES, "ion"])] + [(i % 21, k) for i, k in enumerate(BEYOND)]
WIDE = {f"c{i}": [k for c, k in _KEYWORDS if c == i] for i in range(21)}
_SYL = "[" + ", ".join(f"'{s}'" for s in SYLLABLES) + "]"
_SYL2 = "[" + ", ".join(f"'{s}'" for s in [*SYLLABLES, "ion"]) + "]"
_A, _B = f"(select unnest({_SYL}) as s, unnest(range(24)) as i) a", f"(select unnest({_SYL2}) as s, unnest(range(25)) as i) b"
_WIDE = f"""(select a.s || b.s as keyword, ((a.i * 25 + b.i) % 21)::int as category from {_A}, {_B} union all
select a.s || b.s || c.s, ((a.i * 25 + b.i + c.i) % 21)::int from {_A}, {_B}, (select unnest({_SYL}) as s, unnest(range(24)) as i) c where c.i < 16)"""
_PHRASES = f"(select a.s || ' ' || b.s as keyword, ((a.i + b.i) % 21)::int as category from {_A}, {_B})"
_BEYOND = "(select unnest(['é', 'ñ', 'ü', 'für', 'über', 'être en', 'él', 'ción', 'ß', 'घर', 'गृह कर्ज', 'ಸಾಲ']) as keyword, unnest(range(12))::int as category)"
#: Lower-case texts in which all but words and blanks is a full stop, with one at both ends.
_EDGED = "(select doc_id, '.' || regexp_replace(lower(text), '[^\\p{L}\\p{N}_ ]', '.', 'g') || '.' as t from documents)"
_TOKENS = "(select distinct doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) as token from documents)"


@query(f"""with h as (select doc_id, category, keyword from {_TOKENS} t join {_WIDE} k on k.keyword = t.token union all
select doc_id, category, keyword from {_EDGED} d join {_PHRASES} k on contains(t, '.' || keyword || '.') or contains(t, ' ' || keyword || '.') or contains(t, '.' || keyword || ' ') or contains(t, ' ' || keyword || ' ') union all
select doc_id, category, keyword from {_EDGED} d join {_BEYOND} k on contains(t, '.' || keyword) or contains(t, ' ' || keyword)), s as (select doc_id, category, count(*) as n, sum(case when contains(keyword, ' ') then 1.5::double else 1 end) as w from h group by 1, 2)
select d.doc_id, coalesce(sum(n), 0)::bigint as hits, count(category) as categories, coalesce(round(max(w) / sum(w), 6), 0) as top_share from documents d left join s using (doc_id) group by 1""")
def keyword_hits(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = keywords.table_hits(docs, "doc_id", "text", keywords.lexicon_table(spark, WIDE)).select("doc_id", F.col("hits").alias("h"))
    shares = keywords.rule_scores(F.col("h"), len(WIDE))
    return found.select("doc_id", F.size("h").cast("long").alias("hits"), F.size(keywords.hits_by_category(F.col("h"), list(WIDE))).cast("long").alias("categories"), F.round(F.array_max(shares), 6).alias("top_share"))


NAMES = {"low": ["ing", "the"], "middle": ["ble"], "high": ["zzz"]}
_MEMORY = "select source as key, count(*) filter (where quality = 0) as a, count(*) filter (where quality = 1) as b, count(*) as w from documents join labels using (doc_id) where quality in (0, 1) group by 1"


def _memory(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    return classifier.memory_shares(rows.withColumn("label", F.element_at(F.array(F.lit("low"), F.lit("middle")), F.col("quality") + 1)), "source", "label", list(NAMES))


@query(f"select key as memory_key, round(a / w, 6) as low, round(b / w, 6) as middle from ({_MEMORY})")
def advertiser_memory(spark, sf):
    return _memory(spark, sf).select("memory_key", F.round(F.col("remembered")[0], 6).alias("low"), F.round(F.col("remembered")[1], 6).alias("middle"))


@query(f"select key as memory_key, case when key in ('src1', 'src3') then 0 else round(a / w, 6) end as low, case when key = 'src1' then 1.0 when key = 'src3' then 0 else round(b / w, 6) end as middle from ({_MEMORY})")
def remember_correction(spark, sf):
    fixes = spark.createDataFrame([("src1", "low", 1), ("src1", "middle", 2), ("src3", "high", 1)], "memory_key string, category string, ts long")
    known = _memory(spark, sf)
    after = classifier.remember(known, fixes.join(known.select("memory_key"), "memory_key", "left_semi"), list(NAMES))
    return after.select("memory_key", F.round(F.col("remembered")[0], 6).alias("low"), F.round(F.col("remembered")[1], 6).alias("middle"))


_PREDICT = f"""with m as ({_MEMORY}), d as (select doc_id, substr(text, 1, 90) as title, source, n_chars from documents),
b as (select *, trim(title || ' ' || source || ' ' || source) as body from d),
t as (select *, regexp_split_to_array(lower(body), '[^\\p{{L}}\\p{{N}}_]+') as w from b),
k as (select *, (list_contains(w, 'ing')::int + list_contains(w, 'the')::int)::double as r0, list_contains(w, 'ble')::int::double as r1, list_contains(w, 'zzz')::int::double as r2 from t),
l as (select *, (n_chars % 10) / 20.0::double as l0, (doc_id % 7) / 14.0::double as l1, (doc_id % 4) / 8.0::double as s0, (doc_id % 3) / 6.0::double as s1 from k),
g as (select *, case when doc_id % 5 = 0 then [l0, l1, 1 - l0 - l1] else [0.75 * s0 + 0.25 * l0, 0.75 * s1 + 0.25 * l1, 0.75 * (1 - s0 - s1) + 0.25 * (1 - l0 - l1)] end as base, r0 + r1 + r2 as rt from l),
h as (select *, case when rt > 0 then [0.7 * base[1] + 0.3 * (r0 / rt), 0.7 * base[2] + 0.3 * (r1 / rt), 0.7 * base[3] + 0.3 * (r2 / rt)] else base end as ruled from g),
f as (select h.*, m.key, case when m.key is null then ruled else [0.5 * ruled[1] + 0.5 * (a / w_), 0.5 * ruled[2] + 0.5 * (b / w_), 0.5 * ruled[3]] end as score from h left join (select key, a::double as a, b::double as b, w::double as w_ from m) m on m.key = h.source),
u as (select doc_id, i, round(score[i], 9) as x, score[i] as raw, row_number() over (partition by doc_id order by score[i] desc, i desc) as place from f, unnest([1, 2, 3]) q(i))
select f.doc_id, ['low', 'middle', 'high'][max(case when place = 1 then i end)] as category, max(case when place = 1 then x end) as confidence, max(case when place = 3 then x end) as third,
  any_value(case when f.doc_id % 5 = 0 then 'lexical' else 'semantic' end || case when rt > 0 then '+rules' else '' end || case when f.key is not null then '+advertiser' else '' end) as method,
  bool_or(place = 1 and raw < 0.35) as needs_review from f join u on u.doc_id = f.doc_id group by 1"""


@query(_PREDICT)
def predict(spark, sf):
    part = lambda a, b: F.array(a, b, 1 - a - b)
    docs = table(spark, sf, "documents")
    lexical = part(F.col("n_chars") % 10 / 20, F.col("doc_id") % 7 / 14)
    semantic = F.when(F.col("doc_id") % 5 != 0, part(F.col("doc_id") % 4 / 8, F.col("doc_id") % 3 / 6))
    ads = docs.select("doc_id", F.substring("text", 1, 90).alias("title"), F.lit("").alias("description"), F.col("source").alias("advertiser"), F.col("source").alias("domain"), lexical.alias("lexical"), semantic.alias("semantic"))
    told = classifier.predict_many(ads, NAMES, _memory(spark, sf), [], digits=9)
    return told.select("doc_id", "category", "confidence", F.col("alternatives")[2]["score"].alias("third"), "method", "needs_review")


def _labelled(spark, sf):
    """Documents with a quality label as training rows: the whole text describes, the source advertises."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels").where("quality in (0, 1)"), "doc_id")
    category = F.element_at(F.array(F.lit("low"), F.lit("middle")), F.col("quality") + 1)
    return rows.select("doc_id", F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("description"), F.lit("").alias("advertiser"), F.col("source").alias("domain"), category.alias("category"))


@query()
def cross_validation(spark, sf):
    """Accuracy and macro F1 of models that never saw a source, and accuracy with memory, ten models fitted in one pass; a test holds the models against plain Python."""
    ads = _labelled(spark, sf).withColumnRenamed("category", "actual").withColumn("group", F.col("domain"))
    answers = lexical.cross_validated(ads, "doc_id", "group", NAMES, [], slots=2**11, rounds=40, keep=["actual"]).select("actual", "category", "known").persist()
    return lexical.validation_report(answers)


@query()
def fit_to_answer(spark, sf):
    """Answers of a classifier that was trained on the labelled documents, stored and loaded again, for all documents."""
    folder = scratch(spark, "models")
    settings = lifecycle.Settings(slots=2**14, fold_slots=2**11, rounds=40)
    lifecycle.train(_labelled(spark, sf), "doc_id", NAMES, [], settings=settings).save(folder)

    def missing():
        raise RuntimeError("the model that was just stored can't be read")

    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("description"), F.lit("").alias("advertiser"), F.col("source").alias("domain"))
    told = lifecycle.load(spark, folder, missing).predict_many(docs, "doc_id")
    return told.select("doc_id", "category", "confidence", "method", "needs_review", "certainty")


@query(f"select doc_id, category, confidence, 3 as n from ({_PREDICT})")
def prediction_subset(spark, sf):
    part = lambda a, b: F.array(a, b, 1 - a - b)
    lexical_scores = part(F.col("n_chars") % 10 / 20, F.col("doc_id") % 7 / 14)
    semantic = F.when(F.col("doc_id") % 5 != 0, part(F.col("doc_id") % 4 / 8, F.col("doc_id") % 3 / 6))
    ads = table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 90).alias("title"), F.lit("").alias("description"), F.col("source").alias("advertiser"), F.col("source").alias("domain"), lexical_scores.alias("lexical"), semantic.alias("semantic"))
    told = classifier.predict_many(ads, NAMES, _memory(spark, sf), [], digits=9)
    return reports.prediction_subset(told, "doc_id").select("doc_id", "category", "confidence", F.size("alternatives").alias("n"))


@query("select l_orderkey, l_linenumber, round((l_quantity - (select median(l_quantity) from lineitem)) / ((select stddev_pop(l_quantity) from lineitem) + 1e-3), 6) as quantity from lineitem")
def standardise_by_median(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"))
    return classifier.standardised(rows, ["quantity"], F.median, 1e-3).withColumn("quantity", F.round("quantity", 6))


_GUESSES = "(select label % 3 as a, (vec_id % 7 % 3)::int as p from embeddings)"


@query(f"""with c as (select x as c, count(*) filter (where a = x and p = x) as hit, count(*) filter (where p = x) as g, count(*) filter (where a = x) as s from {_GUESSES}, unnest([0, 1, 2]) q(x) group by 1)
select (select round(avg((a = p)::int), 3) from {_GUESSES}) as accuracy, round(avg(coalesce(2.0 * hit / nullif(s + g, 0), 0)), 3) as macro_f1 from c""")
def accuracy_macro_f1(spark, sf):
    rows = table(spark, sf, "embeddings").select((F.col("label") % 3).alias("a"), (F.col("vec_id") % 7 % 3).cast("int").alias("p"))
    return classifier.accuracy_and_f1(rows, "a", "p")


@query("select l_orderkey, l_linenumber, round((l_quantity - (select avg(l_quantity) from lineitem)) / ((select stddev_pop(l_quantity) from lineitem) + 1e-6), 6) as quantity from lineitem")
def standardise(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"))
    return classifier.standardised(rows, ["quantity"]).withColumn("quantity", F.round("quantity", 6))


@query()
def calibrate(spark, sf):
    """The certainty of each vector's best centroid, fitted on whether that is its label's."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.abs(F.col("embedding")[0]).cast("double").alias("a"), F.abs(F.col("embedding")[1]).cast("double").alias("b"))
    best = rows.select("vec_id", F.greatest("a", "b").alias("top"), F.least("a", "b").alias("second"), (F.col("label") < 5).cast("int").alias("right"))
    certainty = classifier.fit_calibration(best, "top", "second", "right")
    return best.select("vec_id", F.round(certainty(F.col("top"), F.col("second")), 4).alias("certainty"))


@query(f"""with c as (select x as class, count(*) filter (where a = x and p = x) as hit, count(*) filter (where p = x) as g, count(*) filter (where a = x) as s from {_GUESSES}, unnest([0, 1, 2]) q(x) group by 1)
select (row_number() over (order by round(coalesce(2.0 * hit / nullif(s + g, 0), 0), 6), class))::int as place, class from c""")
def weakest_classes(spark, sf):
    rows = table(spark, sf, "embeddings").select((F.col("label") % 3).alias("a"), (F.col("vec_id") % 7 % 3).cast("int").alias("p"))
    return model.confusion_metrics(rows, "a", "p").selectExpr("cast(row_number() over (order by f1, class) as int) as place", "class")


_WORDS = f"regexp_extract_all(lower(text), '{W}[\\p{{L}}\\p{{N}}_''®]*{W}')"


@query(f"""with t as (select doc_id, {_WORDS} as t from documents), g as (select doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) as term from t)
select term, count(*) as n, count(distinct doc_id) as documents from g group by 1""")
def word_grams(spark, sf):
    each = table(spark, sf, "documents").select(F.explode(text.marked_terms(text.word_grams(F.col("text")))).alias("e")).select("e.*")
    return each.groupBy("term").agg(F.count("*").alias("n"), F.count_if("first").alias("documents"))


@query("""with w as (select conv_id, turn, ' ' || unnest(list_filter(regexp_split_to_array(lower(text), '[\\s\\p{Z}]+'), lambda x: x <> '')) || ' ' as w from conversations),
g as (select substr(w, i, n) as term from w, unnest([2, 3, 4, 5]) s(n), unnest(range(1, greatest(length(w) - n + 2, 1))) q(i))
select term, count(*) as n from g group by 1""")
def char_grams(spark, sf):
    each = table(spark, sf, "conversations").select(F.explode(text.char_grams(F.col("text"))).alias("term"))
    return each.groupBy("term").agg(F.count("*").alias("n"))

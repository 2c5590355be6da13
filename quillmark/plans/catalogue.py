"""All queries of the reporting engine by name, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import boxes, keywords, text, urls
from quillmark.operators import library, model, reports, spatial, tfidf
from quillmark.sources.readers import cards, links, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A small lexicon over words that occur in the documents.
LEXICON = {"articles": ["the", "der", "la"], "links": ["and", "und", "que"], "places": ["in the", "with", "dans"]}
NETWORKS = ["src1", "src2"]
W = text.WORD_CHAR


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query("select event_type as category, count(*) as n, round(sum(value), 2) as total, round(avg(value), 2) as mean from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-25 23:59:59' group by 1")
def stats_by_category(spark, sf):
    ev = table(spark, sf, "events").where(reports.seen_between(F.col("ts"), "2024-01-05", "2024-01-25"))
    return reports.by_group(ev.withColumnRenamed("event_type", "category"), "category", "value")


@query("select count(*) as total, coalesce(sum(case when event_type = 'view' then 1 else 0 end), 0)::bigint as views, count(distinct user_id) as advertisers, count(*) filter (where event_type = 'error') as needs_review, coalesce(round(avg(value), 3), 0) as mean, strftime(max(ts), '%d %b %Y') as last_updated from events")
def kpi_summary(spark, sf):
    kind = F.col("event_type")
    return table(spark, sf, "events").agg(
        F.count("*").alias("total"), F.coalesce(F.sum((kind == "view").cast("long")), F.lit(0)).alias("views"), F.countDistinct("user_id").alias("advertisers"),
        F.count_if(kind == "error").alias("needs_review"), F.coalesce(F.round(F.avg("value"), 3), F.lit(0.0)).alias("mean"), F.date_format(F.max("ts"), "dd MMM yyyy").alias("last_updated"),
    )


@query("select substr(min(ts)::varchar, 1, 10) as first_day, substr(max(ts)::varchar, 1, 10) as last_day from events")
def date_range_unfiltered(spark, sf):
    return table(spark, sf, "events").agg(F.substring(F.min("ts").cast("string"), 1, 10).alias("first_day"), F.substring(F.max("ts").cast("string"), 1, 10).alias("last_day"))


@query("select lang as network, count(*) as n from documents group by 1")
def by_network(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("lang").alias("network")).agg(F.count("*").alias("n"))


@query("select lower(source) as advertiser_lower, lang, count(*) as creatives, sum(n_chars)::bigint as impressions, min(source) as advertiser from documents where lang <> 'es' group by 1, 2 order by creatives desc, impressions desc, 1, 2 limit 80")
def top_advertisers(spark, sf):
    docs = table(spark, sf, "documents").where("lang <> 'es'")
    grouped = docs.groupBy(F.lower("source").alias("advertiser_lower"), "lang").agg(F.count("*").alias("creatives"), F.sum("n_chars").alias("impressions"), F.min("source").alias("advertiser"))
    return grouped.orderBy(F.desc("creatives"), F.desc("impressions"), "advertiser_lower", "lang").limit(80)


@query("select event_type, count(*) as n, round(count(*) / (sum(count(*)) over ()), 6) as share, round(count(*) / (max(count(*)) over ()), 6) as share_of_most from events group by 1")
def share_of_total(spark, sf):
    return reports.share_of_total(table(spark, sf, "events"), "event_type")


@query("select doc_id, source, lang, n_chars from documents where lang = 'en' and (text ilike '%th_re%' or source ilike '%th_re%')")
def library_search(spark, sf):
    return table(spark, sf, "documents").where((F.col("lang") == "en") & reports.matches(["text", "source"], "th_re")).select("doc_id", "source", "lang", "n_chars")


@query("select d.doc_id, d.source from documents d join labels l using (doc_id) where l.quality = 0 and l.toxic = 0")
def review_queue(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels").where("quality = 0 and toxic = 0"), "doc_id").select("doc_id", "source")


@query("select event_id, event_type from events where user_id in (3, 7, 11)")
def id_in_list(spark, sf):
    return table(spark, sf, "events").where(F.col("user_id").isin(3, 7, 11)).select("event_id", "event_type")


@query("select doc_id from documents where doc_id in (select doc_id from labels)")
def known_semi(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_semi")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def unknown_anti(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("select doc_id, coalesce(l.quality, case when n_chars > 500 then 1 else 0 end) as quality from documents d left join (select doc_id, max(quality) as quality from labels group by 1) l using (doc_id)")
def known_else_model(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return library.known_else(docs, table(spark, sf, "labels"), "doc_id", "quality", F.when(F.col("n_chars") > 500, 1).otherwise(0)).select("doc_id", "quality")


@query("select coalesce(r_name, 'none') as region, count(*) as n, round(sum(c_acctbal), 2) as balance from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey group by 1")
def dim_lookup_default(spark, sf):
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    found = table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return found.groupBy(F.coalesce("r_name", F.lit("none")).alias("region")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("c_acctbal").cast("decimal(18,2)")), 2).cast("double").alias("balance"))


@query("select event_type, event_id, user_id from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as k from events) where k = 1")
def latest_per_category(spark, sf):
    return reports.latest_per(table(spark, sf, "events"), "event_type", [F.col("ts")], ["event_id", "user_id"])


@query("select sha1(text) as id, arg_min(source, doc_id) as source, min(doc_id) as doc_id from documents group by 1")
def first_wins_dedupe(spark, sf):
    return library.first_wins(table(spark, sf, "documents").withColumn("id", F.sha1("text")), "id", "doc_id", ["source"])


@query("select user_id, arg_max(event_type, event_id) as category from events group by 1")
def last_write_wins(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("category"))


@query("select o_orderkey, o_totalprice from orders order by o_orderdate desc, o_totalprice desc, o_orderkey limit 24 offset 48")
def paginate(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return reports.page_of(rows, [F.desc("o_orderdate"), F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_orderkey", "o_totalprice")


_MERGED = """
with a as (select user_id as id, min(ts) as x, arg_min(ts, event_id) as f, arg_min(event_type, event_id) as c from events where ts < timestamp '2024-01-16' group by 1),
b as (select user_id as id, arg_min(ts, event_id) as f, arg_max(ts, event_id) as l, arg_min(event_type, event_id) as c, count(*) as n from events where ts >= timestamp '2024-01-16' group by 1)
select coalesce(a.id, b.id) as id, coalesce(a.f, b.f) as first_seen, case when a.id is null then b.f else coalesce(b.l, a.f) end as last_seen,
  case when a.id is null then 1 else 1 + coalesce(b.n, 0) end as times_seen, coalesce(a.c, b.c) as category from a full join b on a.id = b.id
"""


@query(_MERGED)
def library_upsert(spark, sf):
    ev = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("category"))
    empty = spark.createDataFrame([], "id long, first_seen timestamp_ntz, last_seen timestamp_ntz, times_seen long, category string")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    return library.merge(library.merge(empty, ev.where(F.col("ts") < cut)), ev.where(F.col("ts") >= cut))


@query("select text, source from (select text, source from documents where lang in ('en', 'de') and trim(text) <> '' union all select text, 'user_feedback' from benchmark)")
def training_union(spark, sf):
    rows = table(spark, sf, "documents").where(F.col("lang").isin("en", "de") & (F.trim("text") != "")).select("text", "source")
    return rows.unionByName(table(spark, sf, "benchmark").select("text"), allowMissingColumns=True).withColumn("source", F.coalesce("source", F.lit("user_feedback")))


@query("select c.range::int as quality, count(l.doc_id) as n from range(3) c left join labels l on l.quality = c.range group by 1")
def dense_class_counts(spark, sf):
    counts = table(spark, sf, "labels").groupBy("quality").agg(F.count("*").alias("n"))
    classes = spark.range(3).select(F.col("id").cast("int").alias("quality"))
    return classes.join(counts, "quality", "left").select("quality", F.coalesce("n", F.lit(0)).alias("n"))


_CLEAN = "regexp_replace(regexp_replace(coalesce({0}, ''), '[\\s\\p{{Z}}]+', ' ', 'g'), '^ | $', '', 'g')"


@query(f"select doc_id, {_CLEAN.format('text')} as cleaned, substr(text, 1, 90) as title, n_chars || ' ' || case when n_chars = 1 then 'character' else 'characters' end as size from documents")
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"), F.substring("text", 1, 90).alias("title"), text.plural(F.col("n_chars"), "character", "characters").alias("size"))


_LINES = "list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\n|\\r'), lambda x: regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), lambda x: x <> '')"


@query(f"select doc_id, {_LINES}[1] as headline, {_LINES}[2] as description, len({_LINES})::int as n_lines from documents")
def lines_fallback(spark, sf):
    found = table(spark, sf, "documents").select("doc_id", text.lines(F.col("text")).alias("l"))
    return found.select("doc_id", F.try_element_at("l", F.lit(1)).alias("headline"), F.try_element_at("l", F.lit(2)).alias("description"), F.size("l").alias("n_lines"))


@query("select c_custkey, case when len(w) = 0 then '•' else upper(array_to_string(list_transform(w[1:2], lambda x: substr(x, 1, 1)), '')) end as initials from (select c_custkey, regexp_extract_all(c_name, '[\\p{L}\\p{N}]+') as w from customer)")
def initials(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", text.initials(F.col("c_name")).alias("initials"))


_DOMAIN = "regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)), '^www\\.', '')"


@query(f"select page_id, substr(sha1(lower({_CLEAN.format('title')}) || '||' || {_DOMAIN}), 1, 16) as id from (select page_id, url, regexp_extract(html, '<title>([^<]*)', 1) as title from pages)")
def ad_identity(spark, sf):
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    return table(spark, sf, "pages").select("page_id", text.ad_id(title, F.lit(""), urls.domain(F.col("url"))).alias("id"))


@query(f"select doc_id, case when source in ('src1', 'src2') then source || ':' || lower({_CLEAN.format('lang')}) else lower(source) end as key from documents")
def advertiser_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.advertiser_key(F.col("source"), F.col("lang"), NETWORKS).alias("key"))


@query(f"select page_id, array_to_string(list_filter([title, array_to_string(list_filter(regexp_split_to_array({_DOMAIN}, '[.\\-_/]+'), lambda t: t not in ('www', 'com', 'in', 'co', 'net', 'org') and t <> ''), ' ')], lambda p: p <> ''), ' ') as built from (select page_id, url, regexp_extract(html, '<title>([^<]*)', 1) as title from pages)")
def build_text(spark, sf):
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    return table(spark, sf, "pages").select("page_id", text.build_text(title, F.lit(""), F.lit(None).cast("string"), urls.domain(F.col("url"))).alias("built"))


@query(f"select {_DOMAIN} as domain, count(*) as n from pages group by 1")
def url_domain(spark, sf):
    return table(spark, sf, "pages").groupBy(urls.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


_BARE = "regexp_replace(url, '#.*$', '')"
_KEPT = f"array_to_string(list_filter(string_split(regexp_extract({_BARE}, '\\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '(?i)^(utm_|fbclid|gclid|ref(=|$))')), '&')"


@query(f"select page_id, regexp_replace({_BARE}, '\\?.*$', '') || case when {_KEPT} = '' then '' else '?' || {_KEPT} end as url from pages")
def strip_tracking(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.strip_tracking(F.col("url")).alias("url"))


@query("select page_id, url_decode(coalesce(nullif(regexp_extract(url, '[?&]adurl=([^&#]*)', 1), ''), nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), ''))) as target from pages")
def click_param(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.parameter(F.col("url"), ["adurl", "page"]).alias("target"))


@query("select doc_id, case when lang in ('en') then '' else source end as domain, coalesce(nullif(trim(source), ''), lang) as advertiser, substr(text, 1, 90) as headline from documents")
def public_projection(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.when(F.col("lang").isin("en"), "").otherwise(F.col("source")).alias("domain"), F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.col("lang")).alias("advertiser"), F.substring("text", 1, 90).alias("headline"))


@query("""select page_id, (k - 1)::int as place, cards[k] as title from (select page_id, regexp_extract_all(html, '<div class="ad">([^<]*)</div>', 1) as cards from pages), unnest(range(1, len(cards) + 1)) u(k)""")
def html_cards(spark, sf):
    return cards(table(spark, sf, "pages")).select("page_id", F.col("place"), "title")


@query("""select page_id, array_to_string(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)[1:5], ' ') as links from pages""")
def frame_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(links(F.col("html")), " ").alias("links"))


def _rules_sql() -> str:
    edge = "[^\\p{L}\\p{N}_]"
    sums = ["(" + " + ".join(f"case when regexp_matches(text, '(?i)(?:^|{edge}){k}(?:$|{edge})') then {1 + 0.5 * (len(k.split()) - 1)}::double else 0 end" for k in ks) + ")" for ks in LEXICON.values()]
    names = list(LEXICON)
    cols = ", ".join(f"case when t = 0 then 0 else round(s{i} / t, 6) end as {n}" for i, n in enumerate(names))
    return f"select doc_id, {cols} from (select *, {' + '.join(f's{i}' for i in range(len(names)))} as t from (select doc_id, {', '.join(f'{s} as s{i}' for i, s in enumerate(sums))} from documents))"


@query(_rules_sql())
def keyword_rules(spark, sf):
    scored = table(spark, sf, "documents").select("doc_id", keywords.rule_scores(keywords.keyword_hits(F.col("text"), LEXICON), len(LEXICON)).alias("s"))
    return scored.select("doc_id", *[F.round(F.col("s")[i], 6).alias(n) for i, n in enumerate(LEXICON)])


@query("select source, quality, round(count(*) / sum(count(*)) over (partition by source), 6) as share from documents join labels using (doc_id) group by 1, 2")
def memory_share(spark, sf):
    return model.memory(table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id"), "source", "quality")


@query("""with e as (select vec_id, label, embedding[1]::double as a, embedding[2]::double as b, embedding[3]::double as c from embeddings),
s as (select vec_id, [0.75 * a + 0.25 * b, 0.75 * b + 0.25 * c, 0.75 * c + 0.25 * a] as v, [(label = 0)::int::double, (label = 1)::int::double, (label = 2)::int::double] as r from e),
t as (select vec_id, case when r[1] + r[2] + r[3] > 0 then [0.7 * v[1] + 0.3 * r[1], 0.7 * v[2] + 0.3 * r[2], 0.7 * v[3] + 0.3 * r[3]] else v end as v from s),
u as (select vec_id, i - 1 as i, v[i] as x, row_number() over (partition by vec_id order by v[i] desc, i desc) as k from t, unnest([1, 2, 3]) q(i))
select vec_id, max(case when k = 1 then i end)::int as best, max(case when k = 2 then i end)::int as second, round(max(case when k = 1 then x end), 6) as score from u group by 1""")
def blend_rank(spark, sf):
    at = lambda i: F.col("embedding")[i].cast("double")
    rules = F.array(*[(F.col("label") == i).cast("int").cast("double") for i in range(3)])
    scores = model.blend(F.array(at(0), at(1), at(2)), F.array(at(1), at(2), at(0)), rules, F.lit(None).cast("array<double>"))
    best = table(spark, sf, "embeddings").select("vec_id", model.ranked(scores).alias("r"))
    return best.select("vec_id", F.col("r")[0]["index"].alias("best"), F.col("r")[1]["index"].alias("second"), F.round(F.col("r")[0]["score"], 6).alias("score"))


def _tfidf_sql(terms: str, source: str) -> str:
    return f"""with tf as (select id, term, count(*) as tf from (select id, unnest({terms}) as term from {source}) group by 1, 2), n as (select count(*) as n from {source}),
df as (select term, count(*) as df from tf group by 1), raw as (select id, tf.term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) as w from tf join df on df.term = tf.term, n),
len as (select id, sqrt(sum(w * w)) as l from raw group by 1) select raw.id, term, round(w / l, 6) as weight from raw join len on len.id = raw.id"""


@query(_tfidf_sql(f"regexp_extract_all(lower(text), '{W}[\\p{{L}}\\p{{N}}_''®]*{W}')", "(select item_id as id, text from benchmark)"))
def tfidf_word(spark, sf):
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return model.tfidf(rows, "id", text.tokens(F.col("text"))).select("id", "term", F.round("weight", 6).alias("weight"))


@query(_tfidf_sql("list_transform(range(1, length(lower(text)) - 1), lambda i: substr(lower(text), i, 3))", "(select item_id as id, text from benchmark)"))
def tfidf_char(spark, sf):
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.lower("text").alias("text"))
    return model.tfidf(rows, "id", text.trigrams(F.col("text"))).select("id", "term", F.round("weight", 6).alias("weight"))


@query()
def tfidf_word_documents(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return tfidf.tfidf(rows, "id", text.tokens(F.col("text"))).select("id", "term", F.round("weight", 6).alias("weight"))


@query()
def tfidf_char_documents(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return tfidf.tfidf_trigrams(rows, "id", F.lower("text")).select("id", "term", F.round("weight", 6).alias("weight"))


@query("""with c as (select label, i, avg(embedding[i]::double) as m from embeddings, range(1, 65) r(i) group by 1, 2), n as (select label, sqrt(sum(m * m)) as l from c group by 1)
select e.vec_id, round(sum(e.embedding[c.i]::double * c.m) / greatest(any_value(n.l), 1e-9), 6) as cosine from embeddings e join c on c.label = e.label join n on n.label = e.label group by 1""")
def embedding_centroid_cosine(spark, sf):
    rows = table(spark, sf, "embeddings")
    means = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centroids = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return rows.join(centroids, "label").select("vec_id", F.round(dot(F.col("embedding"), F.col("c")) / F.greatest(F.sqrt(dot(F.col("c"), F.col("c"))), F.lit(1e-9)), 6).alias("cosine"))


@query("select doc_id, (('0x' || substr(sha1(source), 1, 6))::int % 5)::int as fold from documents")
def fold_assignment(spark, sf):
    return table(spark, sf, "documents").select("doc_id", model.fold(F.col("source")).alias("fold"))


@query("""with p as (select label % 3 as a, (vec_id % 7 % 3)::int as p from embeddings), c as (select range::int as class from range(3))
select class::int as class, count(*) filter (where a = class) as support, round(coalesce(count(*) filter (where a = class and p = class) / nullif(count(*) filter (where p = class), 0), 0), 6) as precision,
round(coalesce(count(*) filter (where a = class and p = class) / nullif(count(*) filter (where a = class), 0), 0), 6) as recall,
round(coalesce(2 * count(*) filter (where a = class and p = class) / nullif(count(*) filter (where a = class) + count(*) filter (where p = class), 0), 0), 6) as f1 from p, c group by 1""")
def confusion_metrics(spark, sf):
    rows = table(spark, sf, "embeddings").select((F.col("label") % 3).alias("a"), (F.col("vec_id") % 7 % 3).cast("int").alias("p"))
    return model.confusion_metrics(rows, "a", "p")


@query("""select case when abs(value) % 1 >= .9 then '0.90+' when abs(value) % 1 >= .75 then '0.75-0.90' when abs(value) % 1 >= .5 then '0.50-0.75' else 'below 0.50' end as band, count(*) as n,
round(avg((event_type in ('view', 'click'))::int), 6) as accuracy, round(count(*) / sum(count(*)) over (), 6) as share from events group by 1""")
def reliability_bands(spark, sf):
    rows = table(spark, sf, "events").select((F.abs("value") % 1).alias("p"), F.col("event_type").isin("view", "click").cast("int").alias("hit"))
    return model.reliability(rows, "p", "hit")


@query("select quality, count(*) as n, round(sum(count(*)) over () / (count(*) over () * count(*)), 6) as weight from labels group by 1")
def class_weights(spark, sf):
    return model.class_weights(table(spark, sf, "labels"), "quality")


@query()
def softmax_train(spark, sf):
    rows = table(spark, sf, "embeddings")
    scored = model.softmax_scores(model.softmax_fit(rows, "embedding", "label", 8.0), rows, "embedding")
    return scored.select("vec_id", "label", model.ranked(F.col("scores"), 1)[0]["index"].alias("predicted"), F.round(F.array_max("scores"), 4).alias("confidence"))


_LOGIT = "ln(({0} + 1e-4) / (1 - {0} + 1e-4))"


@query(f"select event_id, round(1 / (1 + exp(-(0.5 + ({_LOGIT.format('p')} - 0.1) / 1.5 * 0.8 + ({_LOGIT.format('p')} - {_LOGIT.format('q')} - 0.2) / 2.0 * 0.4 + (p - q - 0.3) / 0.5 * 0.2))), 6) as probability from (select event_id, abs(value) % 1 as p, (abs(value) % 1) / 2 as q from events)")
def calibration(spark, sf):
    p = F.abs("value") % 1
    return table(spark, sf, "events").select("event_id", F.round(model.calibrated(model.calibration_features(p, p / 2), [0.1, 0.2, 0.3], [1.5, 2.0, 0.5], [0.8, 0.4, 0.2], 0.5), 6).alias("probability"))


_BOXES = "select l_orderkey as page, l_linenumber::bigint as {1}, ((l_partkey * {0}) % 400)::bigint as x1, ((l_suppkey * {0}) % 400)::bigint as y1, ((l_partkey * {0}) % 400 + 20 + l_quantity * 8)::bigint as x2, ((l_suppkey * {0}) % 400 + 20 + l_quantity * 6)::bigint as y2 from lineitem"


def _boxes(spark, sf, factor: int, name: str) -> DataFrame:
    x, y, q = F.col("l_partkey") * factor % 400, F.col("l_suppkey") * factor % 400, F.col("l_quantity")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("long").alias(name), x.alias("x1"), y.alias("y1"), (x + 20 + q * 8).cast("long").alias("x2"), (y + 20 + q * 6).cast("long").alias("y2"))


_PAIRS = f"""with d as ({_BOXES.format(1, 'det')}), a as ({_BOXES.format(3, 'ans')}), p as (
select d.page, det, ans, greatest(least(d.x2, a.x2) - greatest(d.x1, a.x1), 0) * greatest(least(d.y2, a.y2) - greatest(d.y1, a.y1), 0) as s, (d.x2 - d.x1) * (d.y2 - d.y1) as da, (a.x2 - a.x1) * (a.y2 - a.y1) as aa,
(d.x1 + d.x2) / 2 between a.x1 and a.x2 and (d.y1 + d.y2) / 2 between a.y1 and a.y2 as inside from d join a on a.page = d.page), m as (
select page, det, ans, round(s / (da + aa - s), 6) as iou from p where s / (da + aa - s) >= 0.3 or inside and da >= 0.25 * aa)"""


@query(f"{_PAIRS} select * from m")
def box_iou_match(spark, sf):
    return spatial.candidates(_boxes(spark, sf, 1, "det"), _boxes(spark, sf, 3, "ans"))


@query(f"{_PAIRS} select page, det from d where not exists (select 1 from m where m.page = d.page and m.det = d.det)")
def false_positive_anti(spark, sf):
    found = _boxes(spark, sf, 1, "det")
    return found.join(spatial.candidates(found, _boxes(spark, sf, 3, "ans")), ["page", "det"], "left_anti").select("page", "det")


#: Answers of a page in their order, one a step, each with the first detection that none took before.
_GREEDY = f"""{_PAIRS.replace('with d', 'with recursive d', 1)}, o as (select page, ans, row_number() over (partition by page order by ans) as k from (select distinct page, ans from m)),
g as (select page, 0::bigint as k, null::bigint as ans, null::bigint as det, []::bigint[] as used from (select distinct page from m) union all
select g.page, o.k, o.ans, t.det, case when t.det is null then g.used else list_append(g.used, t.det) end from g join o on o.page = g.page and o.k = g.k + 1
left join lateral (select min(m.det) as det from m where m.page = g.page and m.ans = o.ans and not list_contains(g.used, m.det)) t on true)"""


@query(f"{_GREEDY} select m.page, m.det, m.ans, max(m.iou) as iou from m join g on g.page = m.page and g.ans = m.ans and g.det = m.det group by 1, 2, 3")
def greedy_assignment(spark, sf):
    return spatial.assigned(spatial.candidates(_boxes(spark, sf, 1, "det"), _boxes(spark, sf, 3, "ans")))


def _kept_sql(covered: str) -> str:
    """Boxes of a page by falling area, one a step, kept if none that was kept before covers them."""
    return f"""with recursive b as (select *, (x2 - x1) * (y2 - y1) as area from ({_BOXES.format(1, 'det')})), o as (select *, row_number() over (partition by page order by area desc, det, x1, y1, x2, y2) as k from b),
e as (select page, k, by_ from (select s.page, s.k, l.k as by_, s.area as own, l.area as area, greatest(least(s.x2, l.x2) - greatest(s.x1, l.x1), 0) * greatest(least(s.y2, l.y2) - greatest(s.y1, l.y1), 0) as shared from o s join o l on l.page = s.page and l.k < s.k) where {covered}),
n as (select page, k, list(by_) as covers from e group by 1, 2),
r as (select page, 0::bigint as k, false as stays, []::bigint[] as kept from (select distinct page from o) union all
select r.page, o.k, not list_has_any(coalesce(n.covers, []), r.kept), case when list_has_any(coalesce(n.covers, []), r.kept) then r.kept else list_append(r.kept, o.k) end from r join o on o.page = r.page and o.k = r.k + 1 left join n on n.page = o.page and n.k = o.k)
select o.page, o.det, x1, y1, x2, y2 from o join r on r.page = o.page and r.k = o.k where stays"""


@query(_kept_sql("shared >= 0.7 * greatest(own, 1) or area >= 0.6 * 200000 and shared >= 0.5 * greatest(own, 1)"))
def nested_drop(spark, sf):
    return spatial.without_nested(_boxes(spark, sf, 1, "det"), 200_000)


@query("""with f as (select user_id, event_id, (value > 0)::int as on_ from events), g as (select *, row_number() over (partition by user_id order by event_id) - sum(on_) over (partition by user_id order by event_id rows unbounded preceding) as i from f)
select user_id, min(event_id) as first, max(event_id) as last, count(*) as length from g where on_ = 1 group by user_id, i having count(*) >= 2""")
def separator_runs(spark, sf):
    return spatial.runs(table(spark, sf, "events"), "user_id", "event_id", F.col("value") > 0, 2)


@query("select user_id, count(*) as n, string_agg(event_id::varchar, ' ' order by event_id) as spots from events group by 1")
def spots_per_ad(spark, sf):
    grouped = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("event_id")).alias("s"))
    return grouped.select("user_id", "n", F.array_join(F.transform("s", lambda x: x.cast("string")), " ").alias("spots"))


@query("select event_id, round(case when event_type = 'view' then greatest(c, a, 1 - (1 - c) * (1 - a)) else a * 0.9 end, 6) as certainty from (select event_id, event_type, abs(value) % 1 as c, (abs(value) * 3) % 1 as a from events)")
def fusion(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(model.agreed(F.abs("value") % 1, F.abs("value") * 3 % 1, F.col("event_type") == "view"), 6).alias("certainty"))


@query("select page, round_even(least(greatest(x1, 0), 1000) * 600 / 1000.0::double, 0)::int as left_px from (" + _BOXES.format(1, "det") + ")")
def box_rescale(spark, sf):
    return _boxes(spark, sf, 1, "det").select("page", boxes.rescale(F.col("x1"), F.lit(600)).alias("left_px"))

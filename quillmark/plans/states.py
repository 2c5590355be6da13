"""Queries of the library's state: labels, feedback, reclassification, the run log, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import text, urls
from quillmark.operators import library, reports
from quillmark.plans.catalogue import query
from quillmark.session import scratch
from quillmark.sources import creatives, store
from quillmark.sources.readers import table
from quillmark.streaming import intake

_LIB = """(select doc_id as id, substr(text, 1, 40) as title, '' as description, case when doc_id % 11 = 0 then '' else source end as advertiser, lang || '.example' as domain, 'http://' || lang || '.example/?utm_a=1&p=' || doc_id as landing_url,
case when quality = 0 then 'low' else 'fine' end as category, (n_chars % 100) / 100.0::double as confidence, 'lexical' as method, coalesce(toxic, 0) as needs_review, (doc_id % 7 = 0)::int as manual_label,
'2024-01-' || lpad((doc_id % 28 + 1)::varchar, 2, '0') || 'T10:00:00' as first_seen, '2024-02-' || lpad((doc_id % 20 + 1)::varchar, 2, '0') || 'T10:00:00' as last_seen, (doc_id % 5 + 1)::bigint as times_seen
from documents left join labels using (doc_id))"""


def _library(spark, sf):
    day = lambda month, days: F.concat(F.lit(f"2024-{month}-"), F.lpad((F.col("doc_id") % days + 1).cast("string"), 2, "0"), F.lit("T10:00:00"))
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return rows.select(
        F.col("doc_id").alias("id"), F.substring("text", 1, 40).alias("title"), F.lit("").alias("description"), F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.col("source")).alias("advertiser"), F.concat("lang", F.lit(".example")).alias("domain"),
        F.concat(F.lit("http://"), "lang", F.lit(".example/?utm_a=1&p="), "doc_id").alias("landing_url"), F.when(F.col("quality") == 0, "low").otherwise("fine").alias("category"), (F.col("n_chars") % 100 / 100).alias("confidence"),
        F.lit("lexical").alias("method"), F.coalesce("toxic", F.lit(0)).alias("needs_review"), (F.col("doc_id") % 7 == 0).cast("int").alias("manual_label"), day("01", 28).alias("first_seen"), day("02", 20).alias("last_seen"), (F.col("doc_id") % 5 + 1).alias("times_seen"),
    )


_STATE = ["id", "category", "confidence", "method", "needs_review", "manual_label"]


@query(f"""with c as (select event_id % 300 as id, arg_max(event_type, (ts, event_type)) as label from events group by 1)
select l.id, coalesce(label, category) as category, case when label is null then confidence else 1 end as confidence, case when label is null then method else 'manual' end as method,
case when label is null then needs_review else 0 end as needs_review, greatest(manual_label, (label is not null)::int) as manual_label from {_LIB} l left join c on c.id = l.id""")
def set_label(spark, sf):
    fixes = table(spark, sf, "events").select((F.col("event_id") % 300).alias("id"), F.col("event_type").alias("category"), "ts")
    return library.labelled(_library(spark, sf), fixes).select(*_STATE)


@query(f"select title, description, advertiser, domain, category from {_LIB} where manual_label = 1")
def feedback_rows(spark, sf):
    return library.feedback_rows(_library(spark, sf))


@query(f"select id, title, description, advertiser, domain from {_LIB} where manual_label = 0")
def unlabelled_ads(spark, sf):
    return library.unlabelled(_library(spark, sf))


@query(f"""select id, case when hit then 'new' else category end as category, case when hit then 0.5 else confidence end as confidence, case when hit then 'semantic' else method end as method,
case when hit then 1 else needs_review end as needs_review, manual_label from (select *, id % 3 = 0 and manual_label = 0 as hit from {_LIB})""")
def reclassify(spark, sf):
    answers = table(spark, sf, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.lit("new").alias("category"), F.lit(0.5).alias("confidence"), F.lit("semantic").alias("method"), F.lit(True).alias("needs_review"))
    return library.reclassified(_library(spark, sf), answers).select(*_STATE)


_AFTER = f"""(with old as (select id::varchar as id, first_seen, last_seen, times_seen, category, confidence, method, needs_review, manual_label from {_LIB}),
e as (select user_id::varchar as id, event_id as seq, strftime(ts, '%Y-%m-%dT%H:%M:%S') as ts, event_type from events where user_id is not null), b as (select id, arg_min(ts, seq) as f, arg_max(ts, seq) as l, arg_min(event_type, seq) as c, count(*) as n from e group by 1),
m as (select coalesce(old.id, b.id) as id, coalesce(first_seen, f) as first_seen, case when old.id is null then f else coalesce(l, last_seen) end as last_seen, case when old.id is null then 1 else times_seen + coalesce(n, 0) end as times_seen, case when old.id is null then c else category end as category, coalesce(manual_label, 0) as manual_label from old full outer join b on old.id = b.id),
k as (select user_id::varchar as id, arg_max(event_type, event_id) as label from events where event_type = 'error' group by 1)
select m.id, first_seen, last_seen, times_seen::bigint as times_seen, coalesce(label, category) as category, case when label is null then manual_label else 1 end as manual_label from m left join k on k.id = m.id)"""


def _stored(spark, sf):
    """The documents' library in buckets."""
    rows = _library(spark, sf).withColumn("id", F.col("id").cast("string"))
    whole = [F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in store.COLUMNS.split(", "))]
    held = store.LibraryStore(spark, scratch(spark, "library"), buckets=16)
    held.seed(rows.select(*whole))
    return held


_SEEN = ["id", "first_seen", "last_seen", "times_seen", "category", "manual_label"]


@query(f"select * from {_AFTER}")
def library_in_place(spark, sf):
    """Sightings merged into buckets, twice under one name, then labels; the second merge changes nothing."""
    held = _stored(spark, sf)
    events = table(spark, sf, "events").where("user_id is not null").select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("event_type").alias("category"))
    for _ in range(2):
        held.merge(events, "events")
    held.label(events.where("category = 'error'").select("id", "category", F.col("seq").alias("ts")))
    return held.read().select(*_SEEN)


@query(f"select * from {_AFTER}")
def intake_stream(spark, sf):
    """The same as a stream: events as elements, errors as a person's labels beside them, over all files that are there."""
    held = _stored(spark, sf)
    events = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")  # a pattern, since a table may be one file
    element = F.struct(F.lit(None).cast("string").alias("label"), F.concat(F.lit("e"), "event_id").alias("element"))
    label = F.when(F.col("event_type") == "error", F.struct(F.col("event_type").alias("label"), F.concat(F.lit("l"), "event_id").alias("element")))
    both = events.where("user_id is not null").withColumn("x", F.explode(F.filter(F.array(element, label), lambda e: e.isNotNull())))
    rows = both.select("x.element", F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("category"), "x.label")
    log = intake.RunLog(spark, scratch(spark, "runs"))
    intake.Intake(held, log, scratch(spark, "checkpoint"), within="1000 days").run(rows)
    return held.read().select(*_SEEN)


_SHOWN = f"(select *, case when id % 4 = 0 then '' else 'https://img/' || id end as image_url, domain || '-' || (id % 13) as kind from {_LIB})"


def _shown(spark, sf):
    return _library(spark, sf).withColumns({"image_url": F.when(F.col("id") % 4 == 0, "").otherwise(F.concat(F.lit("https://img/"), F.col("id").cast("string"))), "category": F.concat("domain", F.lit("-"), (F.col("id") % 13).cast("string"))})


@query(f"select id, kind as category, last_seen from (select *, row_number() over (partition by kind order by last_seen desc, times_seen desc, id desc) as n from {_SHOWN} where image_url <> '') where n = 1 order by kind = 'en.example-1', last_seen desc, times_seen desc, id limit 8")
def showcase(spark, sf):
    return reports.showcase(_shown(spark, sf), "en.example-1").select("id", "category", "last_seen")


@query(f"select id, image_url <> '' as has_image from {_SHOWN}")
def has_image(spark, sf):
    return _shown(spark, sf).select("id", reports.has_image(F.col("image_url")).alias("has_image"))


@query(f"select count(*) filter (where length(trim(regexp_replace(title, '[\\s\\p{{Z}}]+', ' ', 'g'))) > 2) as recognised, count(*) filter (where confidence >= 0.5) as categorised, count(*) filter (where confidence < 0.5) as uncertain from {_LIB}")
def scan_counters(spark, sf):
    return reports.scan_counters(_library(spark, sf).select(F.col("title").alias("headline"), F.col("confidence").alias("certainty")))


@query(f"select id, strftime(first_seen::timestamp, '%d %b %Y') as day, '' as none from {_LIB}")
def day_labels(spark, sf):
    return _library(spark, sf).select("id", reports.day_label(F.col("first_seen")).alias("day"), reports.day_label(F.col("title")).alias("none"))


@query(f"select id, domain = 'en.example' and (advertiser = '' or contains('enexample', lower(advertiser))) as listing from {_LIB}")
def network_listings(spark, sf):
    return _library(spark, sf).select("id", reports.network_listing(F.col("advertiser"), F.col("domain"), ["en.example"]).alias("listing"))


@query("with o as (select o_orderkey, o_totalprice, row_number() over (order by o_orderdate desc, o_totalprice desc, o_orderkey) - 1 as k from orders) select o_orderkey, o_totalprice from o where k // 24 = (select max(k) // 24 from o)")
def last_page(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    pages = reports.Pages(rows, [F.desc("o_orderdate"), F.desc("o_totalprice"), F.col("o_orderkey")])
    return pages.page(pages.pages).select("o_orderkey", "o_totalprice")


_RUNS = """(select run, min(t) as started_at, max(case when found is not null or error is not null then t end) as finished_at, coalesce(max(found), 0) as ads_found, coalesce(max(n), 0) as new_ads, max(error) as log
from (select event_id // 4 as run, ts as t, case when event_id % 4 = 3 and event_type <> 'view' then user_id % 3 end as found, case when event_id % 4 = 3 then 1 end as n, case when event_id % 4 = 3 and event_type = 'error' then 'lost' end as error from events) group by 1)"""
_STATUS = "case when finished_at is null then 'running' when log is not null or ads_found = 0 then 'failed' else 'success' end"


def _runs(spark, sf):
    last = F.col("event_id") % 4 == 3
    events = table(spark, sf, "events").select(F.floor(F.col("event_id") / 4).alias("run"), F.col("ts").alias("at"), F.when(last & (F.col("event_type") != "view"), F.col("user_id") % 3).alias("found"), F.when(last, F.lit(1).cast("long")).alias("new"), F.when(last & (F.col("event_type") == "error"), "lost").alias("error"))
    return library.runs_log(events)


@query(f"select run, started_at, finished_at, {_STATUS} as status, ads_found, new_ads from {_RUNS}")
def run_log(spark, sf):
    return _runs(spark, sf).select("run", "started_at", "finished_at", "status", "ads_found", "new_ads")


@query(f"select run, {_STATUS} as status from {_RUNS} order by run desc limit 5")
def last_runs(spark, sf):
    return library.last_runs(_runs(spark, sf)).select("run", "status")


@query(f"select max(finished_at) as last_success, round(date_sub('second', max(finished_at), timestamp '2024-02-01 00:00:00') / 3600.0::double, 6) as hours, coalesce(date_sub('second', max(finished_at), timestamp '2024-02-01 00:00:00') >= 21600, true) as due from {_RUNS} where {_STATUS} = 'success'")
def collection_due(spark, sf):
    found = library.due(_runs(spark, sf), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"), 6)
    return found.withColumn("hours", F.round("hours", 6))


@query(f"""select category as "Category", title as "Headline", description as "Description", case when advertiser = '' then domain else advertiser end as "Advertiser", case when network then '' else domain end as "Website",
case when network then '' else 'http://' || domain || '/?p=' || id end as "Link", substr(first_seen, 1, 10) as "First seen", substr(last_seen, 1, 10) as "Last seen" from (select *, domain = 'en.example' as network from {_LIB})""")
def report_rows(spark, sf):
    return creatives.report_rows(creatives.public_ads(_library(spark, sf), ["en.example"]))


@query(f"select id, json_extract_string(j, '$.category') as category, json_extract(j, '$.times_seen')::bigint as times_seen from (select id, json_object('category', category, 'times_seen', times_seen) as j from {_LIB})")
def json_rows(spark, sf):
    body = creatives.as_json(_library(spark, sf).select("id", "category", "times_seen"))
    return body.select(F.from_json("body", "id long, category string, times_seen long").alias("j")).select("j.*")


@query(f"select category, count(*) as n, sum(times_seen)::bigint as impressions, count(*) filter (where manual_label = 1) as manual, count(*) filter (where needs_review = 1 and manual_label = 0) as review, round(avg(confidence), 2) as conf from {_LIB} where first_seen >= '2024-01-05' and first_seen <= '2024-01-20T23:59:59' group by 1")
def library_stats(spark, sf):
    rows = _library(spark, sf).where("first_seen >= '2024-01-05' and first_seen <= '2024-01-20T23:59:59'")
    manual = F.col("manual_label") == 1
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.sum("times_seen").alias("impressions"), F.count_if(manual).alias("manual"), F.count_if((F.col("needs_review") == 1) & ~manual).alias("review"), F.round(F.avg("confidence"), 2).alias("conf"))


@query(f"select (row_number() over (order by (category = 'low')::int, last_seen desc, times_seen desc, id) - 1)::int as place, id from {_LIB} order by place limit 24")
def category_last(spark, sf):
    top = reports.one_last(_library(spark, sf), F.col("category") == "low", [F.desc("last_seen"), F.desc("times_seen"), F.col("id")]).limit(24)
    return top.selectExpr("cast(row_number() over (order by category = 'low', last_seen desc, times_seen desc, id) - 1 as int) as place", "id")


@query(f"select id, case when confidence >= 0.75 then 'strong' when confidence >= 0.5 then 'good' else 'possible' end as strength, case when confidence >= 0.75 then 'Good' when confidence >= 0.5 then 'Partial' else 'Poor' end as reading, confidence < 0.5 as flagged, landing_url <> '' as has_link from {_LIB} where category in ('low', 'fine') and regexp_full_match(domain, '[a-z]{{2}}\\.example')")
def match_strength(spark, sf):
    rows = _library(spark, sf).where(F.col("category").isin("low", "fine") & F.col("domain").rlike(r"^[a-z]{2}\.example$"))
    return rows.select("id", reports.strength(F.col("confidence")).alias("strength"), reports.reading(F.col("confidence")).alias("reading"), (F.col("confidence") < 0.5).alias("flagged"), (F.col("landing_url") != "").alias("has_link"))


@query(f"select id, contains(regexp_replace(lower(domain), '[^a-z0-9]', '', 'g'), 'en') as named from {_LIB}")
def brand_in_domain(spark, sf):
    return _library(spark, sf).select("id", text.name_in_domain(F.lit("E-N"), F.col("domain")).alias("named"))


@query("select preset, count(e.event_id) as n from (values ('today', 1), ('week', 7), ('month', 30)) p(preset, days) left join events e on e.ts::date between date '2024-01-30' - (days - 1)::int and date '2024-01-30' group by 1")
def date_presets(spark, sf):
    first = reports.preset_start(F.lit("2024-01-30").cast("date"))
    day = F.col("ts").cast("date")
    counts = table(spark, sf, "events").where(day <= F.lit("2024-01-30").cast("date")).agg(*[F.count_if(day >= c).alias(n) for n, c in first.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("preset"), F.col(n).alias("n")) for n in first])).alias("e")).select("e.*")


@query("select event_id, date_sub('second', ts, timestamp '2024-01-30 12:00:00') < 600 as fresh from events where ts <= timestamp '2024-01-30 12:00:00'")
def snapshot_fresh(spark, sf):
    now = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    return table(spark, sf, "events").where(F.col("ts") <= now).select("event_id", reports.fresh(F.col("ts"), now, 600).alias("fresh"))


_KEYS = "utm_|tbl|taboola|gclid|fbclid|dclid|msclkid|clickid|click_id|campaign|site|platform|thumbnail|title|cpc|pubid|adid|ad_id|creative|placement|network|source|ref$"
_PAIR = "list_transform(list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\\?(.*)$', 1), '&'), lambda p: p <> ''), lambda p: {k: url_decode(replace(regexp_extract(p, '^([^=]*)', 1), '+', ' ')), v: url_decode(replace(regexp_extract(p, '^[^=]*=(.*)$', 1), '+', ' '))})"
_CODED = "array_to_string(list_transform(list_filter(" + _PAIR + f", lambda e: not regexp_matches(e.k, '(?i)^({_KEYS})')), lambda e: replace(url_encode(e.k), '%20', '+') || '=' || replace(url_encode(e.v), '%20', '+')), '&')"


@query(f"select page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '\\?.*$', '') || case when q = '' then '' else '?' || q end as url from (select page_id, url, {_CODED} as q from pages)")
def landing_page(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.landing_page(F.col("url")).alias("url"))

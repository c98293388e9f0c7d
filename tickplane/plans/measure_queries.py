"""Aggregates, choices and decision rules over the ordinary tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickplane.functions.scalars import CADENCES, blind_code
from tickplane.operators import measures as ms
from tickplane.operators import planes, reports
from tickplane.plans.registry import query
from tickplane.tables import load


@query("select source, lang, count(*) as n, cast(sum(n_chars) as bigint) as total, max(n_chars) as largest from documents group by all")
def chunk_distribution(spark, sf_dir):
    return ms.distribution(load(spark, sf_dir, "documents"), ["source", "lang"], "n_chars")


@query("""
select event_type, coalesce(quantile_disc(value, 0.5), 0) as p50, coalesce(quantile_disc(value, 0.75), 0) as p75, coalesce(quantile_disc(value, 0.95), 0) as p95
from events group by event_type""")
def rank_percentiles(spark, sf_dir):
    return ms.nearest_rank(load(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p75": 0.75, "p95": 0.95})


@query("select event_type, cast(floor(quantile_cont(value, 0.5) + 0.5) as bigint) as median from events group by event_type")
def classic_median(spark, sf_dir):
    return ms.classic_median(load(spark, sf_dir, "events"), ["event_type"], "value")


@query("""
with c as (select p_brand, p_type, count(*) as n from part group by all having count(*) >= 2),
t as (select *, row_number() over (order by n desc, p_brand, p_type) as rank from c)
select * from t where rank <= 64""")
def token_dictionary(spark, sf_dir):
    return ms.top_tokens(load(spark, sf_dir, "part"), ["p_brand", "p_type"], 2, 64)


@query("""
with c as (select p_brand, p_type, count(*) as n from part group by all having count(*) >= 2),
t as (select *, row_number() over (order by n desc, p_brand, p_type) as rank from c)
select cast(sum(n * 2) - count(*) * 3 - 3 as bigint) as saving, sum(n * 2) - count(*) * 3 - 3 > 0 as pays from t where rank <= 64""")
def dictionary_payoff(spark, sf_dir):
    top = ms.top_tokens(load(spark, sf_dir, "part"), ["p_brand", "p_type"], 2, 64)
    saving = F.sum(F.col("n") * 2) - F.count("*") * 3 - 3
    return top.agg(saving.cast("long").alias("saving"), (saving > 0).alias("pays"))


@query("""
with c as (select user_id, event_type, count(*) as n from events group by all),
r as (select *, row_number() over (partition by user_id order by n desc, event_type) as k from c)
select user_id, event_type, n from r where k = 1""")
def modal_token(spark, sf_dir):
    return ms.modal(load(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("""
with c as (select lang, byte, count(*) as n from (select lang, unnest(regexp_extract_all(hex(encode(text)), '..')) as byte from documents) group by all),
t as (select lang, sum(n) + 0.5 * 256 as total from c group by lang)
select lang, cast(sum(n) as bigint) as symbols, round(sum(n * -log2((n + 0.5) / total)), 4) as bits from c join t using (lang) group by lang""")
def symbol_entropy(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("lang", F.col("text").cast("binary").alias("raw"))
    return ms.smoothed_cost(ms.byte_counts(docs, ["lang"], "raw"), ["lang"], "byte", "n", 0.5, 256).withColumn("bits", F.round("bits", 4))


@query("""
select event_type, cast(sum(m * b) as bigint) as mask, any_value(n) as n from (
    select event_type, unnest([1, 2, 4, 8, 16]) as b, unnest([
        (avg((cast(floor(value) as bigint)) & 1) >= 0.5)::int, (avg((cast(floor(value) as bigint) >> 1) & 1) >= 0.5)::int,
        (avg((cast(floor(value) as bigint) >> 2) & 1) >= 0.5)::int, (avg((cast(floor(value) as bigint) >> 3) & 1) >= 0.5)::int,
        (avg((cast(floor(value) as bigint) >> 4) & 1) >= 0.5)::int]) as m, count(*) as n
    from events group by event_type) group by event_type""")
def majority_bits(spark, sf_dir):
    events = load(spark, sf_dir, "events").withColumn("bits", F.floor("value").cast("long"))
    return ms.majority_bits(events, ["event_type"], "bits", 5, 0.5)


@query("""
select l_returnflag, round(avg((l_tax - l_discount) * (l_tax - l_discount)), 9) as mse, round(sqrt(avg((l_tax - l_discount) * (l_tax - l_discount))), 9) as rmse,
    round(avg(abs(l_tax - l_discount)), 9) as mae, round(max(abs(l_tax - l_discount)), 9) as worst,
    round(10 * log10(0.01 / avg((l_tax - l_discount) * (l_tax - l_discount))), 6) as psnr,
    round(10 * log10(avg(l_tax * l_tax) / avg((l_tax - l_discount) * (l_tax - l_discount))), 6) as snr
from lineitem group by l_returnflag""")
def signal_comparison(spark, sf_dir):
    found = load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*ms.signal_measures(F.col("l_tax"), F.col("l_discount"), 0.1))
    return found.select("l_returnflag", *(F.round(c, 9).alias(c) for c in ("mse", "rmse", "mae", "worst")), *(F.round(c, 6).alias(c) for c in ("psnr", "snr")))


@query("""
with p as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as place, value from events)
select user_id, cast(floor(place / 10.0) as bigint) as window_no, round(sqrt(avg(value * value)), 6) as rms, max(abs(value)) as peak from p group by all""")
def window_rms(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    levels = load(spark, sf_dir, "events").select("user_id", place.cast("long").alias("place"), "value")
    return ms.window_rms(levels, ["user_id"], "place", "value", 10).withColumn("rms", F.round("rms", 6))


@query("""
with c as (
    select l_orderkey, l_extendedprice / l_quantity + 4 * l_discount as objective, l_discount, l_extendedprice, cast(l_linenumber as bigint) as line from lineitem),
r as (select *, row_number() over (partition by l_orderkey order by objective, l_discount, l_extendedprice, line) as k from c)
select l_orderkey, objective, l_discount, l_extendedprice, line from r where k = 1""")
def candidate_choice(spark, sf_dir):
    objective = F.col("l_extendedprice") / F.col("l_quantity") + 4 * F.col("l_discount")
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", objective.alias("objective"), "l_discount", "l_extendedprice", F.col("l_linenumber").cast("long").alias("line"))
    order = ["objective", "l_discount", "l_extendedprice", "line"]
    return ms.least_by(lines, ["l_orderkey"], order, order)


@query("""
with s as (
    select o_orderpriority as p, 100 * sum(l_extendedprice * l_discount) / sum(l_extendedprice) as saving
    from lineitem join orders on o_orderkey = l_orderkey where o_orderpriority in ('1-URGENT', '5-LOW') group by 1),
d as (select round(0.75 * max(saving) filter (p = '1-URGENT') + 0.25 * max(saving) filter (p = '5-LOW'), 6) as weighted, round(min(saving), 6) as worst from s)
select weighted, worst, weighted >= 3 and worst >= -1 as accepted from d""")
def weighted_decision(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    chosen = load(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).select("o_orderkey", F.col("o_orderpriority").alias("p"))
    saved = lines.join(chosen, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("p").agg((100 * F.sum(F.col("l_extendedprice") * F.col("l_discount")) / F.sum("l_extendedprice")).alias("saving"))
    pick = lambda p: F.max(F.when(F.col("p") == p, F.col("saving")))
    both = saved.agg(F.round(0.75 * pick("1-URGENT") + 0.25 * pick("5-LOW"), 6).alias("weighted"), F.round(F.min("saving"), 6).alias("worst"))
    return both.withColumn("accepted", (F.col("weighted") >= 3) & (F.col("worst") >= -1))


@query("""
select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as quantity
from lineitem group by rollup (l_returnflag, l_linestatus)""")
def corpus_totals(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""
select source, case when count(toxic) = count(*) then cast(sum(toxic) as bigint) end as total, count(*) as n
from documents left join labels using (doc_id) group by source""")
def strict_totals(spark, sf_dir):
    met = load(spark, sf_dir, "documents").select("doc_id", "source").join(load(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return met.groupBy("source").agg(ms.strict_total("toxic").cast("long").alias("total"), F.count("*").alias("n"))


@query("""
with s as (select o_orderpriority as p, sum(o_totalprice) as total, count(*) as n from orders group by 1),
b as (select total / n as base from s where p = '3-MEDIUM')
select p, round(total / n, 4) as mean, round(100 * (base - total / n) / base, 4) as saving from s, b""")
def finding_deltas(spark, sf_dir):
    sums = load(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg((F.sum("o_totalprice") / F.count("*")).alias("mean"))
    base = sums.where("p = '3-MEDIUM'").select(F.col("mean").alias("base"))  # one row
    met = sums.join(F.broadcast(base))
    return met.select("p", F.round("mean", 4).alias("mean"), F.round(ms.percent_saving(F.col("base"), F.col("mean")), 4).alias("saving"))


@query("""
with q as (select user_id, sum(length(props)) as size, 60 * date_diff('millisecond', min(ts), max(ts)) as ticks from events group by user_id)
select user_id, case when ticks > 0 then cast(floor(size * 8 * 60000 / ticks + 0.5) as bigint) end as rate from q""")
def bit_rates(spark, sf_dir):
    ms_of = lambda c: F.unix_millis(c.cast("timestamp"))
    events = load(spark, sf_dir, "events")
    sums = events.groupBy("user_id").agg(F.sum(F.char_length("props")).alias("size"), (60 * (ms_of(F.max("ts")) - ms_of(F.min("ts")))).alias("ticks"))
    return sums.select("user_id", ms.bits_per_second(F.col("size"), F.col("ticks")).alias("rate"))


@query("""
with p as (select source, n_chars * 8 as rate, row_number() over (partition by source order by doc_id) - 1 as place, count(*) over (partition by source) as n from documents),
o as (select distinct source, cast(floor((n - 1) * i / 4.0) as bigint) as place from (select distinct source, n from p), range(5) t(i)),
s as (select p.*, n as seconds from p join o using (source, place) where rate > 0),
m as (select source, count(*) as samples, min(rate) as low_rate, cast(floor(quantile_cont(rate, 0.5) + 0.5) as bigint) as middle_rate, max(rate) as high_rate, max(seconds) as t from s group by source),
e as (select *, cast(floor((middle_rate + 96000) * t / 8.0 + 0.5) as bigint) + 1024 as estimated, cast(floor(low_rate * t / 8.0 + 0.5) as bigint) + 1024 as l,
    cast(floor(cast(floor(high_rate * 1.25 + 96000 * 1.5 + 0.5) as bigint) * t / 8.0 + 0.5) as bigint) + 1024 as u from m)
select source, samples, low_rate, middle_rate, high_rate, estimated, least(estimated, l) as lower, greatest(estimated, u) as upper from e""")
def size_estimate(spark, sf_dir):
    """A document is a second of its source; five evenly spaced ones tell its rate, sound has 96,000 bits a second."""
    w = Window.partitionBy("source")
    placed = load(spark, sf_dir, "documents").select("source", (F.col("n_chars") * 8).alias("rate"), (F.row_number().over(w.orderBy("doc_id")) - 1).cast("long").alias("place"), F.count("*").over(w).alias("n"))
    sampled = placed.where(F.array_contains(reports.sample_offsets(F.col("n"), 1, 5), F.col("place")))
    return reports.estimated_size(sampled, ["source"], "rate", F.col("n"), F.lit(96000))


@query("select lang, count(distinct source) as sources, count(distinct sha256(text)) as texts, cast(sum(n_chars) as bigint) as total from documents group by lang")
def structural_classes(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("lang").agg(
        F.countDistinct("source").alias("sources"), F.countDistinct(F.sha2("text", 256)).alias("texts"), F.sum("n_chars").cast("long").alias("total")
    )


@query("""
with l as (select source, doc_id // 1024 as lot, sha256(string_agg(sha256(text), ',' order by doc_id)) as h from documents group by all)
select source, sha256(string_agg(h, ',' order by lot)) as digest from l group by source""")
def ordered_stream_hash(spark, sf_dir):
    """Hashes of rows, in order, hashed by ranges of ids and once more."""
    docs = load(spark, sf_dir, "documents").select("source", "doc_id", F.sha2("text", 256).alias("h"))
    return ms.ordered_digest(docs, ["source"], "doc_id", F.col("h"))


@query("""
with g as (select l_shipmode_ as name, cast(sum(bytes) as bigint) as bytes, round(avg(err), 9) as err from (
    select l_returnflag || l_linestatus || '-' || cast(l_linenumber as varchar) as l_shipmode_, floor(l_extendedprice) as bytes, l_discount as err from lineitem) group by name)
select name, row_number() over (order by bytes, err, name) as by_bytes, row_number() over (order by err, bytes, name) as by_error from g""")
def configuration_rankings(spark, sf_dir):
    name = F.concat("l_returnflag", "l_linestatus", F.lit("-"), F.col("l_linenumber").cast("string"))
    lanes = load(spark, sf_dir, "lineitem").groupBy(name.alias("name")).agg(F.sum(F.floor("l_extendedprice")).alias("bytes"), F.round(F.avg("l_discount"), 9).alias("err"))
    return reports.rankings(lanes, "name", "bytes", "err")


@query("""
with t as (select l_returnflag as name, cast(sum(l_quantity) as bigint) as bytes from lineitem group by 1 union all select 'none', null)
select name as winner, bytes from t where bytes is not null order by bytes, name limit 1""")
def cheapest_backend(spark, sf_dir):
    totals = load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("name")).agg(F.sum("l_quantity").cast("long").alias("bytes"))
    return reports.cheapest(totals.unionByName(spark.range(1).select(F.lit("none").alias("name"), F.lit(None).cast("long").alias("bytes"))), "name", "bytes")


@query("""
select event_type, count(*) as files, cast(sum(event_id % 7) as bigint) as frames, round(sum(value) / count(*), 3) as median_per_file, round(max(value * 1.5), 3) as worst_p95,
    round(sum(value), 3) as total_median, max(length(props)) as peak_heap from events group by event_type""")
def decoder_rollup(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 7).alias("frames"), "value", (F.col("value") * 1.5).alias("p95"), F.char_length("props").cast("long").alias("heap"))
    return reports.decoder_rollup(rows, ["event_type"], ["frames"], "value", "p95", ["heap"])


@query("""
with w as (select distinct user_id * 3 as asked from events)
select asked as c_custkey, c_nationkey, c_custkey is null as missing from w left join customer on c_custkey = asked""")
def manifest_selection(spark, sf_dir):
    wanted = load(spark, sf_dir, "events").select((F.col("user_id") * 3).alias("asked"))
    return reports.selected(load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey", wanted, "asked").select("c_custkey", "c_nationkey", "missing")


@query("""
with r as (select p_partkey, case when p_partkey % 5 > 0 then ['12', '24', '25', '60'][cast(p_partkey % 4 + 1 as int)] end as fps, case when p_partkey % 7 > 0 then p_size * 12 end as columns,
    case when p_partkey % 3 > 0 then p_size end as palette, case when p_partkey % 11 > 0 then case when p_size > 25 then 64 else 32 end end as glyphs,
    case when p_partkey % 13 > 0 then ['Smallest', 'balanced', 'CLEAREST', 'best'][cast(p_partkey % 4 + 1 as int)] end as profile from part),
s as (select p_partkey, coalesce(fps, '24') as fps, coalesce(columns, 80) as columns, coalesce(palette, 32) as palette, coalesce(glyphs, 32) as glyphs, lower(coalesce(profile, 'balanced')) as profile from r)
select *, case when fps not in ('0.10', '0.5', '1', '3', '6', '12', '15', '24', '30', '48', '60') then 'fps' when not columns between 1 and 512 then 'columns'
    when palette not in (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 256) then 'palette' when glyphs not in (32, 64) then 'glyphs'
    when profile not in ('smallest', 'balanced', 'clearest') then 'profile' end as fault from s""")
def job_settings(spark, sf_dir):
    pick = lambda names: F.array(*map(F.lit, names))[F.col("p_partkey").cast("int") % 4]
    given = lambda n, c: F.when(F.col("p_partkey") % n > 0, c)
    rows = load(spark, sf_dir, "part").select(
        "p_partkey", given(5, pick(("12", "24", "25", "60"))).alias("fps"), given(7, F.col("p_size") * 12).alias("columns"), given(3, F.col("p_size")).alias("palette"),
        given(11, F.when(F.col("p_size") > 25, 64).otherwise(32)).alias("glyphs"), given(13, pick(("Smallest", "balanced", "CLEAREST", "best"))).alias("profile"),
    )
    return reports.settled(rows, [c[1] for c in CADENCES])


@query("""
with n as (select page_id, regexp_extract(url, '^https?://([^/]*)', 1) || '/' || regexp_extract(url, '([^/?#]*)[^/]*$', 1) as p from pages),
s as (select page_id, p, regexp_extract(p, '^(.*/)', 1) as folder, regexp_extract(p, '([^/]*)$', 1) as name from n),
x as (select page_id, folder || regexp_replace(name, '(.)\\.[^.]*$', '\\1') || case when lower(regexp_extract(name, '.(\\.[^.]*)$', 1)) = '.html' then '.encoded' else '' end || '.html' as wanted from s)
select page_id, wanted, case when row_number() over (partition by wanted order by page_id) = 1 then wanted
    else regexp_replace(wanted, '\\.html$', '.' || cast(row_number() over (partition by wanted order by page_id) as varchar) || '.html') end as output from x""")
def queue_outputs(spark, sf_dir):
    """Output names of a queue's inputs, numbered where a name is taken."""
    path = F.concat(F.regexp_extract("url", "^https?://([^/]*)", 1), F.lit("/"), F.regexp_extract("url", "([^/?#]*)[^/]*$", 1))
    wanted = load(spark, sf_dir, "pages").select("page_id", reports.suggested_name(path, ".html").alias("wanted"))
    return reports.distinct_names(wanted, ["page_id"], "wanted", extension=".html")


@query("""
select s_suppkey, upper(substr(sha256('review' || chr(0) || s_name), 1, 8)) as code, s_nationkey, '' as recognizability_1_to_5, '' as color_or_grayscale_1_to_5, '' as temporal_stability_1_to_5,
    '' as subtitle_transcription, '' as notes from supplier""")
def review_worksheet(spark, sf_dir):
    sheet, key = reports.worksheet(load(spark, sf_dir, "supplier"), ["s_nationkey"], blind_code(F.concat(F.lit("review\0"), "s_name")))
    return key.select("s_suppkey", "code").join(sheet, "code")


@query("""
with p as (select user_id, cast(floor(value / 50) as bigint) as plane, row_number() over (partition by user_id order by ts, event_id) as n from events),
x as (select *, lag(plane) over (partition by user_id order by n) as b from p)
select user_id, count(*) as planes, count(distinct plane) as distinct_planes, cast(sum((b is not null and plane <> b)::int) as bigint) as changed_planes from x group by user_id""")
def changed_planes(spark, sf_dir):
    """Planes that differ from the one before, by their hashes."""
    rows = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.sha2(F.floor(F.col("value") / 50).cast("string"), 256).alias("digest"))
    return planes.measured(rows, ["user_id"], ["ts", "event_id"], "digest")

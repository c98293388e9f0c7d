"""Scalar functions over the ordinary tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickplane.functions import scalars as sc
from tickplane.plans.registry import query
from tickplane.tables import load


@query("""
select doc_id, case when n_chars < 128 then 1 when n_chars < 16384 then 2 when n_chars < 2097152 then 3 when n_chars < 268435456 then 4 else 5 end as bytes from documents""")
def varuint_lengths(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", sc.varuint_length(F.col("n_chars")).alias("bytes"))


@query("""
select vec_id, round(0.2126 * r + 0.7152 * g + 0.0722 * b, 9) as luma, bit_count(cast(floor(r * 255) as bigint)) as ones from (
    select vec_id, least(abs(embedding[1]::double), 1) as r, least(abs(embedding[2]::double), 1) as g, least(abs(embedding[3]::double), 1) as b from embeddings)""")
def luma_popcount(spark, sf_dir):
    c = lambda i: F.least(F.abs(F.col("embedding")[i].cast("double")), F.lit(1.0))
    rgb = load(spark, sf_dir, "embeddings").select("vec_id", c(0).alias("r"), c(1).alias("g"), c(2).alias("b"))
    return rgb.select("vec_id", F.round(sc.luma(F.col("r"), F.col("g"), F.col("b")), 9).alias("luma"), F.bit_count(F.floor(F.col("r") * 255).cast("long")).cast("byte").alias("ones"))


@query("""
with c as (select vec_id, least(abs(embedding[1]::double), 1) as r, least(abs(embedding[2]::double), 1) as g, least(abs(embedding[3]::double), 1) as b from embeddings),
l as (select vec_id, case when r <= 0.04045 then r / 12.92 else pow((r + 0.055) / 1.055, 2.4) end as r, case when g <= 0.04045 then g / 12.92 else pow((g + 0.055) / 1.055, 2.4) end as g,
    case when b <= 0.04045 then b / 12.92 else pow((b + 0.055) / 1.055, 2.4) end as b from c),
m as (select vec_id, cbrt(0.4122214708 * r + 0.5363325363 * g + 0.0514459929 * b) as l, cbrt(0.2119034982 * r + 0.6806995451 * g + 0.1073969566 * b) as m,
    cbrt(0.0883024619 * r + 0.2817188376 * g + 0.6299787005 * b) as s from l)
select vec_id, round(0.2104542553 * l + 0.7936177850 * m - 0.0040720468 * s, 6) as ok_l, round(1.9779984951 * l - 2.4285922050 * m + 0.4505937099 * s, 6) as ok_a,
    round(0.0259040371 * l + 0.7827717662 * m - 0.8086757660 * s, 6) as ok_b from m""")
def oklab_colors(spark, sf_dir):
    c = lambda i: 255 * F.least(F.abs(F.col("embedding")[i].cast("double")), F.lit(1.0))
    l, a, b = sc.oklab(c(0), c(1), c(2))  # noqa: E741
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(l, 6).alias("ok_l"), F.round(a, 6).alias("ok_a"), F.round(b, 6).alias("ok_b"))


@query("select doc_id, upper(substr(sha256(text), 1, 8)) as code, sha256(text) as digest from documents")
def stream_hash(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", sc.blind_code(F.col("text")).alias("code"), F.sha2("text", 256).alias("digest"))


@query("""
select event_id, case when (event_id * 100 * 60000) % 44100 = 0 then cast(event_id * 100 * 60000 // 44100 as bigint) end as ticks from events""")
def sample_ticks(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", sc.samples_to_ticks(F.col("event_id") * 100, F.lit(44100).cast("long")).alias("ticks"))


@query("""
select p_partkey, greatest(1, cast(floor(40 / (p_size / 10.0) / 2 + 0.5) as int)) as rows, case when p_partkey % 180 = 90 then 20 else p_size end as shown_width,
    case when p_partkey % 180 = 90 then p_size else 20 end as shown_height, (p_partkey + 3) % 4 = 1 as dark from part""")
def geometry(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    width, height = sc.rotated(F.col("p_size"), F.lit(20), F.col("p_partkey"))
    return part.select(
        "p_partkey", sc.rows_for(F.lit(40), F.col("p_size") / F.lit(10.0).cast("double")).alias("rows"), width.alias("shown_width"), height.alias("shown_height"), sc.scanline(F.col("p_partkey"), F.lit(3), 4, 1).alias("dark")
    )


@query("""
with s as (select p_partkey, p_size / 30.0::double as a from part),
f as (select p_partkey, case when a >= 80.0::double / 50 then 80 else greatest(1, least(80, cast(floor(50 * a) as int))) end as width,
    case when a >= 80.0::double / 50 then greatest(1, least(50, cast(floor(80 / a) as int))) else 50 end as height from s)
select *, cast(floor((80 - width) / 2) as int) as "left", cast(floor((50 - height) / 2) as int) as top from f""")
def contain_and_pad(spark, sf_dir):
    w, h, left, top = sc.contained_size(F.col("p_size") / F.lit(30.0).cast("double"), 80, 50)
    return load(spark, sf_dir, "part").select("p_partkey", w.alias("width"), h.alias("height"), left.alias("left"), top.alias("top"))


@query("""
with a as (select p_partkey, p_size / 10.0::double as stored, (p_partkey * 15) % 360 as angle from part)
select p_partkey, round(case when angle in (0, 180) then stored when angle in (90, 270) then 1 / stored
    else (stored * abs(cos(radians(angle))) + abs(sin(radians(angle)))) / (stored * abs(sin(radians(angle))) + abs(cos(radians(angle)))) end, 9) as aspect from a""")
def display_aspects(spark, sf_dir):
    aspect = sc.display_aspect(F.col("p_size") / F.lit(10.0).cast("double"), F.col("p_partkey") * 15)
    return load(spark, sf_dir, "part").select("p_partkey", F.round(aspect, 9).alias("aspect"))


@query("select s_suppkey, regexp_matches(lower(regexp_replace(s_name, '[^A-Za-z0-9]+', '-', 'g')), '^[a-z0-9][a-z0-9-]{2,63}$') as legal from supplier")
def output_names(spark, sf_dir):
    return load(spark, sf_dir, "supplier").select("s_suppkey", sc.is_identifier(F.lower(F.regexp_replace("s_name", "[^A-Za-z0-9]+", "-"))).alias("legal"))


@query("""
with b as (select s_suppkey, list_transform(regexp_extract_all(hex(encode(s_name)), '..'), lambda x: cast('0x' || x as hugeint)) as bytes from supplier)
select s_suppkey, lower(printf('%08X%08X', cast(h // 4294967296 as bigint), cast(h % 4294967296 as bigint))) as fnv from (
    select s_suppkey, list_reduce(list_prepend(14695981039346656037::hugeint, bytes), lambda h, x: (xor(h, x) * 1099511628211) % 18446744073709551616::hugeint) as h from b)""")
def fnv_hashes(spark, sf_dir):
    return load(spark, sf_dir, "supplier").select("s_suppkey", sc.fnv1a(F.col("s_name").cast("binary")).alias("fnv"))


@query("""
with c(id, label, numerator, denominator, ticks) as (values (0, '0.10', 1, 10, 600000), (1, '0.5', 1, 2, 120000), (2, '1', 1, 1, 60000), (3, '3', 3, 1, 20000),
    (4, '6', 6, 1, 10000), (5, '12', 12, 1, 5000), (6, '15', 15, 1, 4000), (7, '24', 24, 1, 2500), (8, '30', 30, 1, 2000), (9, '48', 48, 1, 1250), (10, '60', 60, 1, 1000))
select p_partkey, label, coalesce(ticks * 48, -1) as span, id is not null as legal from part left join c on id = p_partkey % 13""")
def cadence_lookup(spark, sf_dir):
    rates = spark.createDataFrame([tuple(x) for x in sc.CADENCES], "id long, label string, numerator int, denominator int, ticks int")
    part = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 13).alias("id"))
    met = part.join(F.broadcast(rates.withColumn("known", F.lit(True))), "id", "left")
    return met.select("p_partkey", "label", F.coalesce(F.col("ticks") * 48, F.lit(-1)).alias("span"), F.coalesce("known", F.lit(False)).alias("legal"))

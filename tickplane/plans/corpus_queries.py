"""Synthetic corpora, planes read back, pauses of sound: made here, told in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickplane.functions.palette import farthest_palette
from tickplane.functions.scalars import CADENCES, MOST_CELLS, MOST_COLUMNS, MOST_ROWS, PALETTE_DEPTHS
from tickplane.operators import corpus, planes, regions
from tickplane.plans import media_queries as media
from tickplane.plans.registry import query
from tickplane.tables import load

#: (id, generator, seed, columns, rows, depth, frames)
ENTRIES = [(f"entry-{i}", name, 1000 + 77 * i, 20, 9, 16, 10) for i, name in enumerate(corpus.PATTERNS)]
FIELDS = "id string, generator string, seed long, columns int, rows int, depth int, frames int"


def _entries(spark) -> DataFrame:
    return spark.createDataFrame(ENTRIES, FIELDS)


@query("""
with g as (select f as frame, c as cell, c % 20 as x, c // 20 as y from range(10) a(f), range(180) b(c)),
l as (select *, (frame * 3) % 28 - 4 as r, (x + y * 2 + frame) // 3 as band, frame // 6 as scene, (x + y + frame * 2) % 6 as pulse, frame // 3 % 26 - 3 as d from g),
s as (
    select 'rapid-motion' as generator, frame, cell,
        case when x >= 17 - r and x < 20 - r and y between 3 and 5 then 7 when x >= r and x < r + 7 and y between 1 and 7 then 48 + frame % 4 else 0 end as glyph,
        case when x >= 17 - r and x < 20 - r and y between 3 and 5 then 5 when x >= r and x < r + 7 and y between 1 and 7 then 12 else 0 end as fore,
        case when x >= 17 - r and x < 20 - r and y between 3 and 5 then 1 when x >= r and x < r + 7 and y between 1 and 7 then 2 else 0 end as back from l
    union all select 'depth-animation', frame, cell, band * 7 % 64, band % 16, (band + 3) % 16 from l
    union all select 'music-video', frame, cell, (scene * 13 + pulse * 7) % 64, (scene * 3 + pulse + 1) % 16, (scene * 5 + x) % 16 from l
    union all select 'saturated-material', frame, cell, (x * 5 + y * 11 + frame) % 64, (x * 3 + y * 5 + frame) % 16, ((x * 3 + y * 5 + frame) % 16 + 7) % 16 from l
    union all select 'dark-cinematography', frame, cell, case when x = 19 - y then 2 when x between d and d + 3 and y between 2 and 8 then 8 else 0 end,
        case when x = 19 - y then 2 when x between d and d + 3 and y between 2 and 8 then 1 else 0 end, 0 from l
    union all select 'screen-capture', frame, cell, case when x = 7 + frame % 11 and y = 3 then 63 when y in (2, 4, 6) and x between 7 and 17 then 10 + (x + y) % 20 when x < 5 and y > 0 then 1 when y = 0 then 4 else 0 end,
        case when x = 7 + frame % 11 and y = 3 then 7 when y in (2, 4, 6) and x between 7 and 17 then 6 when x < 5 and y > 0 then 3 when y = 0 then 7 else 0 end,
        case when x = 7 + frame % 11 and y = 3 then 0 when y in (2, 4, 6) and x between 7 and 17 then 0 when x < 5 and y > 0 then 2 when y = 0 then 1 else 0 end from l)
select generator, frame, sha256(string_agg(printf('%02X%02X%02X', glyph, fore, back), '' order by cell)) as digest from s group by all""")
def corpus_frames(spark, sf_dir):
    """Hashes of the frames of those patterns that plain arithmetic makes."""
    told = ["rapid-motion", "depth-animation", "music-video", "saturated-material", "dark-cinematography", "screen-capture"]
    made = corpus.corpus_states(corpus.corpus_cells(_entries(spark).where(F.col("generator").isin(told))))
    named = _entries(spark).select(F.col("id").alias("path"), "generator")
    return made.join(F.broadcast(named), "path").select("generator", F.col("place").alias("frame"), F.sha2(F.hex("state"), 256).alias("digest"))


@query(None)
def corpus_all_frames(spark, sf_dir):
    return corpus.corpus_states(corpus.corpus_cells(_entries(spark))).select("path", "place", F.sha2("state", 256).alias("digest"))


@query("""
with recursive r as (
    select event_id, 0 as n, (event_id * 2654435761 + 1) & 4294967295 as s from events where event_id < 500
    union all
    select event_id, n + 1, c from (select event_id, n, xor(b, b << 5) & 4294967295 as c from (
        select event_id, n, xor(a, a >> 17) as b from (select event_id, n, xor(s, s << 13) & 4294967295 as a from r where n < 6))))
select event_id, cast(n as bigint) as n, cast(s as bigint) as state from r where n > 0""")
def random_states(spark, sf_dir):
    """Six states of a xorshift generator after each of 500 seeds."""
    seeds = load(spark, sf_dir, "events").where("event_id < 500").select("event_id", (F.col("event_id") * 2654435761 + 1).bitwiseAND(F.lit(corpus.WORD)).alias("seed"))
    return seeds.select("event_id", F.posexplode(corpus.draws(F.col("seed"), 6)).alias("n", "state")).select("event_id", (F.col("n") + 1).cast("long").alias("n"), "state")


@query("""
with m as (select p_partkey, case when p_partkey % 50 = 7 then 'X!' else 'e-' || cast(p_partkey - (p_partkey % 40 = 9)::int as varchar) || '-z' end as id, ['a', 'b', 'c', 'z'][cast(p_partkey % 4 + 1 as int)] as class,
    p_partkey % 23 as seed, p_size * 20 as columns, case when p_partkey % 31 = 0 then 18 else 16 end as depth, p_size as frames from part),
f as (select id, unnest([
    case when not regexp_matches(id, '^[a-z0-9][a-z0-9-]{2,63}$') then 'id' end, case when count(*) over (partition by id) > 1 then 'duplicate' end, case when class = 'z' then 'class' end,
    case when seed = 0 then 'seed' end, case when columns > 512 then 'grid' end, case when depth = 18 then 'depth' end, case when frames < 2 then 'frames' end]) as rule from m)
select id, rule from f where rule is not null union all select 'd', 'class missing'""")
def manifest_faults(spark, sf_dir):
    """Rules that a corpus manifest's entries break."""
    k, size = F.col("p_partkey"), F.col("p_size")
    name = F.when(k % 50 == 7, "X!").otherwise(F.concat(F.lit("e-"), (k - F.when(k % 40 == 9, 1).otherwise(0)).cast("string"), F.lit("-z")))
    entries = load(spark, sf_dir, "part").select(
        name.alias("id"), F.array(*map(F.lit, "abcz"))[(k % 4).cast("int")].alias("structural_class"), F.lit("rapid-motion").alias("generator"), (k % 23).alias("seed"), (size * 20).alias("columns"),
        F.lit(9).alias("rows"), F.when(k % 31 == 0, 18).otherwise(16).alias("depth"), F.lit("24").alias("cadence"), size.alias("frames"),
    )
    return corpus.manifest_faults(entries, list("abcd"), [c[1] for c in CADENCES], PALETTE_DEPTHS, (MOST_COLUMNS, MOST_ROWS, MOST_CELLS))


@query(None)
def generated_palette(spark, sf_dir):
    """A palette of 256 farthest colors."""
    return spark.createDataFrame([(i, *map(int, c)) for i, c in enumerate(farthest_palette())], "place int, r int, g int, b int")


_PLANES = """
with e as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as place, event_type, value from events),
p as (select user_id as stream, place // 8 as frame, event_id % 96 as cell, place, cast(floor(value) as bigint) % 16 as fore, event_id % 16 as back, md5(concat_ws(':', event_type, event_id % 3)) as mask from e),
r as (select *, row_number() over (partition by stream, frame, cell order by place desc) as k from p),
m as (select * from r where k = 1)"""


@query(_PLANES + " select stream, frame, cell, fore, back, mask from m")
def plane_round_trip(spark, sf_dir):
    """Planes coded as sequences and read back."""
    coded = planes.encode_sequences(media.mask_planes(spark, sf_dir), None, media.COLUMNS * media.ROWS, media.DEPTH)
    return planes.decode_sequences(coded).withColumn("mask", F.lower(F.hex("mask")))


@query(_PLANES + """
, s as (select stream, frame // 6 * 6 as start, max(frame) over (partition by stream) + 1 as length, * exclude (stream) from m),
t as (select *, least(start + 6, length) - start as frames from s),
c as (select stream, start, cell, fore, back, count(*) as n from t group by all),
b as (select *, row_number() over (partition by stream, start, cell order by n desc, concat(fore, ',', back)) as k from c),
n as (select stream, start, cell, count(*) as seen, any_value(frames) as frames from t group by all)
select n.stream, n.start, n.cell, b.fore, b.back from n join b using (stream, start, cell) where k = 1 and seen >= greatest(1, ceil(frames * 0.3))""")
def span_consensus(spark, sf_dir):
    """The lasting cells of each six frames and their commonest colors."""
    found = media.mask_planes(spark, sf_dir)
    lengths = found.groupBy("stream").agg((F.max("frame") + 1).alias("length"))
    spans = lengths.select("stream", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(6).cast("long"))).alias("start"))
    spans = spans.select("stream", "start", F.least(F.col("start") + 6, F.col("length")).alias("end"))
    return planes.span_consensus(found, spans, frame_share=0.3, least_ink=0, most_ink=128).select("stream", "start", "cell", "fore", "back")


@query(None)
def span_planes(spark, sf_dir):
    """One plane for each caption span of a stream."""
    found = media.mask_planes(spark, sf_dir)
    return planes.span_consensus(found, regions.span_table(found, least=0.05), least_ink=1, most_ink=128).withColumn("mask", F.hex("mask"))

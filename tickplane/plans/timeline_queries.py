"""Timeline operators over the ordinary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickplane.operators import reports
from tickplane.operators import sequential as sq
from tickplane.operators import timeline as tl
from tickplane.plans.registry import query
from tickplane.tables import load

KEY, ORDER, TOKEN = ["user_id"], ["ts", "event_id"], "event_type"

_PLACED = """
with e as (
    select *, row_number() over w - 1 as place, lag(event_type) over w as previous, lag(event_type, 2) over w as back
    from events window w as (partition by user_id order by ts, event_id)),
c as (select *, place > 0 and event_type is distinct from previous as changed from e)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events")


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)) - 1
    return _events(spark, sf_dir).select("user_id", place.cast("long").alias("place"), "value")


@query(
    _PLACED
    + """
select user_id, count(*) as rows, cast(sum(changed::int) as bigint) as changes,
    round(100 * sum(changed::int) / greatest(count(*) - 1, 1), 6) as changed_percent,
    cast(sum(changed::int) + 1 as bigint) as spans,
    cast(sum((changed and place > 1 and event_type is not distinct from back)::int) as bigint) as flickers
from c group by user_id"""
)
def timeline_stability(spark, sf_dir):
    return tl.stability(_events(spark, sf_dir), KEY, ORDER, TOKEN)


@query(
    _PLACED
    + """
select user_id, event_id, place, case when place % 24 = 0 then 'KEY' when changed then 'DELTA' else 'REPEAT' end as kind from c"""
)
def frame_kind(spark, sf_dir):
    return tl.frame_kind(_events(spark, sf_dir), KEY, ORDER, TOKEN, 24).select("user_id", "event_id", "place", "kind")


@query(
    _PLACED
    + """
, s as (select *, sum(changed::int) over (partition by user_id order by ts, event_id) as span from c)
select user_id, cast(span as bigint) as span, event_type, min(place) as first, max(place) as last, count(*) as rows
from s group by all"""
)
def repeat_spans(spark, sf_dir):
    return tl.repeat_spans(_events(spark, sf_dir), KEY, ORDER, TOKEN)


@query(
    _PLACED
    + """
select user_id, cast(sum((changed and place > 1 and event_type is not distinct from back)::int) as bigint) as flickers from c group by user_id"""
)
def flicker(spark, sf_dir):
    return tl.stability(_events(spark, sf_dir), KEY, ORDER, TOKEN).select("user_id", "flickers")


@query("""
with e as (select user_id, event_id, ts, lead(ts) over (partition by user_id order by ts, event_id) as until from events),
n as (select *, case when event_id % 10 = 0 then ts else until end as told from e where until is not null),
x as (select *, lag(told) over (partition by user_id order by ts, event_id) as expected from n)
select user_id, count(*) as gaps from x where expected is not null and expected <> ts group by user_id""")
def coverage_gaps(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    until = _events(spark, sf_dir).withColumn("until", F.lead("ts").over(w)).where("until is not null")
    told = until.withColumn("told", F.when(F.col("event_id") % 10 == 0, F.col("ts")).otherwise(F.col("until")))
    return tl.continuity(told, KEY, ORDER, "ts", "told").groupBy("user_id").agg(F.count("*").alias("gaps"))


@query("""
with t as (select event_id, user_id, ts from events where event_type = 'error'),
p as (select user_id, ts, max(event_id) as event_id from events where event_type = 'purchase' group by user_id, ts)
select t.event_id, t.user_id, t.ts, p.ts as seek_at, p.event_id as seek_key_id
from t asof left join p on t.user_id = p.user_id and t.ts >= p.ts""")
def seek_asof(spark, sf_dir):
    events = _events(spark, sf_dir)
    keys = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("key_id"))
    targets = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    return tl.seek(keys, targets, KEY, "ts", ["key_id"])


@query("""
select l_orderkey, l_partkey, l_suppkey, cast(l_linenumber as bigint) as line, o_orderkey is not null as inside
from lineitem left join orders on o_orderkey = l_orderkey and l_shipdate >= o_orderdate and l_shipdate < o_orderdate + interval 30 day""")
def interval_contains(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate").withColumn("k", F.col("l_orderkey"))
    spans = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderkey", F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("end"))
    met = tl.contained(lines, spans, ["k"], "l_shipdate", "start", "end", 30 * 86_400 * 1_000_000)
    return met.select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("line"), F.col("o_orderkey").isNotNull().alias("inside"))


_TURNS = """
with t as (
    select conv_id, turn, length(text) as n, sum(length(text)) over (partition by conv_id order by turn, role, text rows unbounded preceding) as e
    from conversations)"""


@query(
    _TURNS
    + """
select conv_id, turn, cast(greatest(e - n, 100) as bigint) as clip_start, cast(least(e, 600) as bigint) as clip_end
from t where e - n < 600 and e > 100"""
)
def window_overlap(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations")
    size = F.char_length("text").cast("long")
    spans = tl.running_offset(turns, ["conv_id"], ["turn", "role", "text"], size, 0).withColumn("end", F.col("offset") + size)
    cut = tl.clipped(spans, "offset", "end", F.lit(100).cast("long"), F.lit(600).cast("long"))
    return cut.select("conv_id", "turn", "clip_start", "clip_end")


_SILENCE = """
with p as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as place, value from events),
m as (select *, case when value <= 40 then 1 when value >= 60 then 2 else 0 end as side from p),
f as (select *, (side <> coalesce(lag(side) over (partition by user_id order by place), -1))::int as fresh from m),
r as (select *, sum(fresh) over (partition by user_id order by place) as run from f),
g as (
    select user_id, side, min(place) as start from r group by user_id, run, side
    having (side = 1 and count(*) >= 3) or (side = 2 and count(*) >= 2)),
t as (select *, lag(side) over (partition by user_id order by start) as before from g),
u as (select *, lead(start) over (partition by user_id order by start) as stop from t where coalesce(before, 2) <> side),
n as (select user_id, max(place) + 1 as length from p group by user_id),
s as (select user_id, start, coalesce(stop, length) as "end" from u join n using (user_id) where side = 1)"""


@query(_SILENCE + ' select user_id, start, "end" from s')
def silence_spans(spark, sf_dir):
    return tl.hysteresis_spans(_levels(spark, sf_dir), KEY, "place", "value", 40, 3, 60, 2)


@query(
    _SILENCE
    + """
, x as (select user_id, start, "end" from s union all select user_id, length, length from n),
y as (select user_id, coalesce(lag("end") over (partition by user_id order by "end", start), 0) as start, start as "end" from x)
select user_id, start, "end" from y where start < "end\""""
)
def span_complement(spark, sf_dir):
    levels = _levels(spark, sf_dir)
    spans = tl.hysteresis_spans(levels, KEY, "place", "value", 40, 3, 60, 2)
    lengths = levels.groupBy("user_id").agg((F.max("place") + 1).alias("length"))
    return tl.complement(spans, lengths, KEY, "start", "end", "length")


@query(
    _SILENCE
    + """
select user_id, p as start, least(p + 4, "end") as "end"
from (select user_id, "end", unnest(range(start, "end", 4)) as p from s)"""
)
def split_spans(spark, sf_dir):
    return tl.split(tl.hysteresis_spans(_levels(spark, sf_dir), KEY, "place", "value", 40, 3, 60, 2), KEY, "start", "end", 4)


@query("""
with recursive e as (
    select user_id, event_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as place from events),
g as (
    select user_id, event_id, place, 0::bigint as group_no, 0::bigint as group_start from e where place = 0
    union all
    select e.user_id, e.event_id, e.place,
        case when e.place - group_start >= 8 or (e.place - group_start >= 2 and e.value >= 150) then group_no + 1 else group_no end,
        case when e.place - group_start >= 8 or (e.place - group_start >= 2 and e.value >= 150) then e.place else group_start end
    from g join e on e.user_id = g.user_id and e.place = g.place + 1)
select user_id, group_no, group_start, count(*) as rows from g group by all""")
def bounded_groups(spark, sf_dir):
    events = _events(spark, sf_dir).select("user_id", "ts", "event_id", "value")
    grouped = sq.bounded_groups(events, KEY, ORDER, "value", 2, 8, 150.0)
    return grouped.groupBy("user_id", "group_no", "group_start").agg(F.count("*").alias("rows"))


@query("""
with recursive e as (
    select user_id, event_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as place from events),
g as (
    select user_id, event_id, place, value as held from e where place = 0
    union all
    select e.user_id, e.event_id, e.place, case when abs(e.value - held) > 25 then e.value else held end
    from g join e on e.user_id = g.user_id and e.place = g.place + 1)
select user_id, event_id, held from g""")
def temporal_hysteresis(spark, sf_dir):
    events = _events(spark, sf_dir).select("user_id", "ts", "event_id", "value")
    return sq.keep_previous(events, KEY, ORDER, "value", 25.0).select("user_id", "event_id", "held")


@query("""
with recursive t as (
    select conv_id, turn, list_distinct(string_split(lower(text), ' ')) as w, row_number() over (partition by conv_id order by turn, role, text) as p
    from conversations),
g as (
    select conv_id, p, turn, 0::bigint as span_no, w as u from t where p = 1
    union all
    select t.conv_id, t.p, t.turn,
        case when len(list_intersect(u, w)) / len(list_distinct(u || w)) >= 0.05 then span_no else span_no + 1 end,
        case when len(list_intersect(u, w)) / len(list_distinct(u || w)) >= 0.05 then list_distinct(u || w) else w end
    from g join t on t.conv_id = g.conv_id and t.p = g.p + 1)
select conv_id, turn, span_no from g""")
def caption_spans(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.array_distinct(F.split(F.lower("text"), " ")).alias("members"))
    return sq.greedy_reference(turns, ["conv_id"], ["turn", "role", "text"], "members", 0.05).select("conv_id", "turn", "span_no")


@query("""
with p as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) - 1 as place from events),
i as (select *, place - row_number() over (partition by user_id, event_type order by place) as island from p)
select user_id, event_type, min(place) as start, count(*) as count from i group by user_id, event_type, island""")
def run_lengths(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)) - 1
    return tl.run_lengths(_events(spark, sf_dir).select("user_id", TOKEN, place.cast("long").alias("place")), KEY, "place", TOKEN)


@query("""
with e as (select user_id, event_id, ts, ts + to_minutes(cast(60 * (event_id % 48) as int)) as until from events),
x as (select *, max(until) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as reached from e)
select user_id, event_id from x where reached > ts""")
def overlapping_spans(spark, sf_dir):
    spans = _events(spark, sf_dir).select("user_id", "event_id", "ts", (F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 48).cast("int"))).alias("until"))
    return tl.overlapping(spans, KEY, ORDER, "ts", "until").select("user_id", "event_id")


@query("""
select doc_id, source, cast(128 + coalesce(sum(n_chars + 32) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset"
from documents""")
def running_offset(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return tl.running_offset(docs, ["source"], ["doc_id"], F.col("n_chars") + 32, 128).select("doc_id", "source", F.col("offset").cast("long").alias("offset"))


@query("""
with t as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as n, cast(floor(value * 1000000) as bigint) as ns from events),
r as (select *, sum(ns::hugeint) over (partition by user_id order by n) as passed from t)
select user_id, event_id, cast(least(passed * 90000 // 1000000000, 120) as bigint) as position, cast((passed * 90000) % 1000000000 as bigint) as remainder from r""")
def playback_clock(spark, sf_dir):
    """Ticks of clocks at 1.5 times the speed, after each step of wall time."""
    steps = _events(spark, sf_dir).select("user_id", "event_id", "ts", F.floor(F.col("value") * 1000000).cast("long").alias("ns"))
    found = reports.playback_clock(steps, KEY, ORDER, "ns", F.lit(120), 3, 2)
    return found.select("user_id", "event_id", "position", F.floor(F.col("remainder") / 2).cast("long").alias("remainder"))


@query("""
with e as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as before from events),
b as (select *, sum((before is null or ts >= before + interval 6 hour)::int) over (partition by user_id order by ts rows unbounded preceding) as n from e)
select user_id, min(ts) as start, max(ts) + interval 6 hour as "end", count(*) as rows from b group by user_id, n""")
def event_sessions(spark, sf_dir):
    return tl.sessions(_events(spark, sf_dir), KEY, "ts", "6 hours")


@query("""
select user_id, ts, event_id, 'silence' as kind from events where value <= 40
union all select user_id, ts, event_id, 'run' as kind from events where value > 40""")
def timeline_merge(spark, sf_dir):
    events = _events(spark, sf_dir).select("user_id", "ts", "event_id", "value")
    quiet = events.where("value <= 40").withColumn("kind", F.lit("silence"))
    return quiet.unionByName(events.where("value > 40").withColumn("kind", F.lit("run"))).drop("value").orderBy("user_id", "ts", "event_id")


@query("""
with p as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as place, count(*) over (partition by user_id) as n from events),
o as (select user_id, n, unnest([0, 1, 2, 3, 4]) as k from (select distinct user_id, n from p)),
w as (select distinct user_id, cast(floor(k * (n - 1) / 4.0) as bigint) as place from o)
select p.user_id, p.place, p.event_id from p join w on p.user_id = w.user_id and p.place = w.place""")
def sample_plan(spark, sf_dir):
    w = Window.partitionBy("user_id")
    placed = _events(spark, sf_dir).select("user_id", "event_id", (F.row_number().over(w.orderBy(*ORDER)) - 1).cast("long").alias("place"), F.count("*").over(w).alias("n"))
    steps = F.sequence(F.lit(0), F.lit(4))
    wanted = F.array_distinct(F.transform(steps, lambda k: F.floor(k * (F.col("n") - 1) / 4.0).cast("long")))
    return placed.where(F.array_contains(wanted, F.col("place"))).select("user_id", "place", "event_id")

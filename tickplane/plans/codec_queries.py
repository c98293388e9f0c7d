"""Codec operators over grid streams made from the events table.

A user's events are a stream of 6 x 4 grids: an event writes the cell of its
number, a glyph from its value and colors from its type.  What the frames, chunks
and faults of the coded files must be is told in SQL from the events alone; byte
counts have no SQL form, tests hold them against round trips.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickplane.functions.scalars import CADENCES
from tickplane.operators import codec, validation
from tickplane.operators import command_reports as reports
from tickplane.plans.registry import query
from tickplane.sources import container
from tickplane.tables import load, stage

COLUMNS, ROWS, DEPTH, CADENCE, INTERVAL = 6, 4, 16, 7, 24
CELLS = COLUMNS * ROWS


#: The frames of ``grid_frames`` in SQL: what each event writes, and whether that changes the grid.
_FRAMES = """
with e as (select cast(user_id as varchar) as path, row_number() over (partition by user_id order by ts, event_id) - 1 as place, event_id % 24 as cell, event_type,
    cast(floor(value) as bigint) % 64 as glyph, (ascii(event_type) * 3 + length(event_type)) % 16 as color from events),
w as (select *, printf('%02X%02X%02X', glyph, color, (color + 1) % 16) as token from e),
o as (select *, lag(token) over (partition by path, cell order by place) as old from w),
f as (select path, place, cell, token, case when place % 24 = 0 then 'key' when old is null or old <> token then 'delta' else 'repeat' end as kind from o),
r as (select *, coalesce(lag(kind) over (partition by path order by place), '') as before from f),
k as (select *, kind <> 'repeat' or before <> 'repeat' as opens from r),
c as (select *, sum(opens::int) over (partition by path order by place) as chunk from k)"""


def grid_frames(spark, sf_dir) -> DataFrame:
    """(path, place, state): the grid after each event; states are made by expressions.

    A cell shows the last event that wrote it, a running last value over the
    stream for each cell.
    """
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", "event_type")
    color = ((F.ascii("event_type") * 3 + F.char_length("event_type")) % DEPTH).cast("int")
    token = F.concat(F.lpad(F.hex(F.pmod(F.floor("value"), F.lit(64))), 2, "0"), F.lpad(F.hex(color), 2, "0"), F.lpad(F.hex(F.pmod(color + 1, F.lit(DEPTH))), 2, "0"))
    placed = events.withColumn("place", F.row_number().over(w) - 1).withColumn("cell", F.pmod(F.col("event_id"), F.lit(CELLS))).withColumn("token", token)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = [F.coalesce(F.last(F.when(F.col("cell") == c, F.col("token")), True).over(running), F.lit("000000")) for c in range(CELLS)]
    return placed.select(F.col("user_id").cast("string").alias("path"), F.col("place").cast("long").alias("place"), F.unhex(F.concat(*cells)).alias("state"))


@query(None)
def command_sizes(spark, sf_dir):
    sizes = codec.command_sizes(grid_frames(spark, sf_dir), COLUMNS, DEPTH, INTERVAL)
    return sizes.groupBy("path").agg(F.count("*").alias("frames"), F.sum("plain_bytes").alias("plain_bytes"), F.sum("packed_bytes").alias("packed_bytes"), F.min(F.col("exact").cast("int")).alias("exact"))


@query(None)
def entropy_refinement(spark, sf_dir):
    return codec.entropy_refined(grid_frames(spark, sf_dir), COLUMNS, DEPTH, INTERVAL)


@query(None)
def command_histogram(spark, sf_dir):
    return reports.command_histogram(grid_frames(spark, sf_dir), COLUMNS, DEPTH, INTERVAL)


@query(_FRAMES + """
select path, cast(sum((kind <> 'repeat')::int) as bigint) as coded_frames, cast(sum((kind <> 'repeat')::int) * 24 as bigint) as cells, true as balanced from f group by path""")
def command_accounts(spark, sf_dir):
    """Coded frames and the cells that their commands account for; bytes are balanced."""
    return reports.command_accounts(grid_frames(spark, sf_dir), COLUMNS, DEPTH, INTERVAL).select("path", "coded_frames", "cells", "balanced")


@query(None)
def backend_matrix(spark, sf_dir):
    return reports.backend_matrix(grid_frames(spark, sf_dir), COLUMNS, DEPTH, INTERVAL)


@query(_FRAMES + """
, s as (select * from (values (0.5, 12), (1.0, 24), (2.0, 48)) t(seconds, size))
select path, cast(seconds as double) as seconds, cast(ceil(count(*) / cast(size as double)) as bigint) as groups, count(*) as frames,
    cast(sum((place % size = 0 or old is null or old <> token)::int) as bigint) as coded_frames, cast(sum((not (place % size = 0 or old is null or old <> token))::int) as bigint) as repeat_frames
from o, s group by path, seconds, size""")
def group_sweep(spark, sf_dir):
    """The same frames in groups of at most half a second, one and two."""
    found = reports.group_sweep(grid_frames(spark, sf_dir), COLUMNS, DEPTH, CADENCE, [0.5, 1, 2])
    return found.select("path", "seconds", "groups", "frames", "coded_frames", "repeat_frames")


@query(None)
def group_sweep_bytes(spark, sf_dir):
    return reports.group_sweep(grid_frames(spark, sf_dir), COLUMNS, DEPTH, CADENCE, [0.5, 1, 2]).select("path", "seconds", "command_bytes", "group_bytes", "deflate_bytes", "huffman_bytes")


def container_parts(spark, sf_dir) -> DataFrame:
    return codec.encode_timelines(grid_frames(spark, sf_dir), COLUMNS, DEPTH, CADENCE, INTERVAL)


def container_files(spark, sf_dir) -> DataFrame:
    return container.mux(container_parts(spark, sf_dir), COLUMNS, ROWS, CADENCE, DEPTH)


@query(_FRAMES + """
, t as (select path, chunk, case when min(kind) = 'repeat' then 'RPTF' else 'VFRM' end as type, count(*) as frames, max(place) + 1 as stop from c group by path, chunk)
select path, type, count(*) as chunks, cast(max(stop) * 2500 as bigint) as until, 0::bigint as errors from t group by path, type
union all select path, 'INDX', 1, 0, 0 from e group by path""")
def container_summary(spark, sf_dir):
    """Files written and read again: chunks, times and faults of each type and file."""
    found = container.chunks(container_files(spark, sf_dir))
    return found.groupBy("path", "type").agg(F.count("*").alias("chunks"), F.max(F.col("timestamp") + F.col("duration")).alias("until"), F.count("error").alias("errors"))


@query(None)
def container_bytes(spark, sf_dir):
    found = container.chunks(container_files(spark, sf_dir))
    return found.groupBy("path", "type").agg(F.sum("stored_length").alias("stored_bytes"), F.sum(F.octet_length("payload")).cast("long").alias("decoded_bytes"))


@query(_FRAMES + """
select path, cast(count(*) * 2500 as bigint) as duration_ticks, count(*) as frames, cast(sum((kind = 'key')::int) as bigint) as keyframes,
    cast(sum((opens and kind = 'repeat')::int) as bigint) as repeat_spans, 0::bigint as audio_runs, 0::bigint as silences, 0::bigint as subtitle_chunks,
    cast(sum(opens::int) + 1 as bigint) as chunks, true as sound from k group by path""")
def verify_summary(spark, sf_dir):
    """What each verified file holds."""
    files = stage(container_files(spark, sf_dir), "files")
    return validation.verify_summary(container.chunks(files), container.headers(files))


@query(_FRAMES + """
, g as (select path, place, unnest(range(24)) as slot from f),
v as (select g.path, g.place, slot, coalesce(last_value(token ignore nulls) over (partition by g.path, slot order by g.place rows unbounded preceding), '000000') as shown
    from g left join f on f.path = g.path and f.place = g.place and f.cell = slot),
d as (select path, place, sha256(unhex(string_agg(shown, '' order by slot))) as digest from v group by path, place),
t as (select path, chunk, min(place) as place, count(*) as n, min(kind) as kind from c group by path, chunk)
select path, cast(place * 2500 as bigint) as timestamp, cast(n * 2500 as bigint) as duration, kind = 'key' as keyframe, kind = 'repeat' as repeat, digest, null::varchar as error from t join d using (path, place)""")
def decoded_states(spark, sf_dir):
    """Hashes of all decoded frames, in order of time."""
    found = codec.decode_timelines(container.chunks(container_files(spark, sf_dir)).where("error is null"), CELLS, COLUMNS, DEPTH)
    return found.select("path", "timestamp", "duration", "keyframe", "repeat", F.sha2("state", 256).alias("digest"), "error")


@query(_FRAMES + """
, g as (select path, place, unnest(range(24)) as slot from f),
v as (select g.path, g.place, slot, coalesce(last_value(token ignore nulls) over (partition by g.path, slot order by g.place rows unbounded preceding), '000000') as shown
    from g left join f on f.path = g.path and f.place = g.place and f.cell = slot),
d as (select path, place, string_agg(shown, '' order by slot) as state from v group by path, place),
t as (select path, chunk, min(place) as place, count(*) as n, min(kind) as kind from c group by path, chunk),
x as (select path, place, array_to_string(list_reverse(regexp_extract_all(printf('%016X', place * 2500), '..')), '') || array_to_string(list_reverse(regexp_extract_all(printf('%016X', n * 2500), '..')), '')
    || case when kind = 'key' then '01' else '00' end || case when kind = 'repeat' then '01' else '00' end || '0000' || '48000000' || state as h from t join d using (path, place)),
z as (select path, '563634474F4C4431' || '0600' || '0400' || array_to_string(list_reverse(regexp_extract_all(printf('%08X', count(*)), '..')), '') || string_agg(h, '' order by place) as h from x group by path)
select path, cast(length(h) // 2 as bigint) as bytes, sha256(h) as digest from z""")
def state_streams(spark, sf_dir):
    """Streams of decoded states, as files."""
    found = codec.decode_timelines(container.chunks(container_files(spark, sf_dir)).where("error is null"), CELLS, COLUMNS, DEPTH)
    whole = codec.state_streams(codec.state_records(found), COLUMNS, ROWS)
    return whole.select("path", F.octet_length("content").cast("long").alias("bytes"), F.sha2(F.hex("content"), 256).alias("digest"))


@query("""
with u as (select distinct cast(user_id as varchar) as path from events)
select path, 'AURN' as type, 1::bigint as chunks from u union all select path, 'INDX', 1 from u union all select path, 'VFRM', n from (""" + _FRAMES + """
select path, count(*) as n from k where opens and kind <> 'repeat' group by path)
union all select path, 'RPTF', n from (""" + _FRAMES + """
select path, count(*) as n from k where opens and kind = 'repeat' group by path)""")
def remuxed_types(spark, sf_dir):
    """Chunks by type of files that have got an audio run, their index made again."""
    found = stage(container.chunks(container_files(spark, sf_dir)), "chunks")
    first = found.where("seq = 0").select("path", F.lit(1_000_000).cast("long").alias("seq"), F.lit("AURN").alias("type"), F.lit(0).cast("long").alias("timestamp"), "duration", F.lit(b"run").alias("payload"))
    files = container.mux(container.remux(found, first), COLUMNS, ROWS, CADENCE, DEPTH)
    return container.chunks(files).groupBy("path", "type").agg(F.count("*").alias("chunks"))


def faulty_files(spark, sf_dir) -> DataFrame:
    """(path, content): files of which some have a fault, by their number modulo 8.

    1: an unknown chunk, 2: no first chunk, 3: a wrong magic, 4: a required
    feature bit unset, 5: cut short, 6: a payload byte changed, 7: remuxed with
    an audio silence.
    """
    parts = container_parts(spark, sf_dir).withColumn("fault", F.col("path").cast("long") % 8)
    kept = parts.where("not (fault = 2 and seq = 0)")
    first = parts.where("seq = 0")
    more = lambda fault, kind, payload: first.where(F.col("fault") == fault).withColumn("type", F.lit(kind)).withColumn("payload", F.lit(payload)).withColumn("seq", F.lit(1_000_000).cast("long"))
    kept = kept.unionByName(more(1, "XYZW", b"?")).unionByName(more(7, "SILN", b""))
    files = container.mux(kept.drop("fault"), COLUMNS, ROWS, CADENCE, DEPTH).withColumn("fault", F.col("path").cast("long") % 8)
    c = F.col("content")
    byte = lambda at, value: F.concat(F.substring(c, 1, at), value, F.substring(c, at + 2, 1 << 30))
    dark = F.unhex(F.lpad(F.hex(validation.little_endian(c, 12, 1).bitwiseAND(F.lit(0xF7))), 2, "0"))
    flipped = F.unhex(F.lpad(F.hex(validation.little_endian(c, 160, 1).bitwiseXOR(F.lit(1))), 2, "0"))
    broken = F.when(F.col("fault") == 3, byte(0, F.lit(b"?"))).when(F.col("fault") == 4, byte(12, dark)).when(F.col("fault") == 5, F.substring(c, 1, 200)).when(F.col("fault") == 6, byte(160, flipped))
    return files.select("path", F.coalesce(broken, c).alias("content"))


@query("""
with u as (select distinct cast(user_id as varchar) as path, user_id % 8 as k from events)
select path, case k when 3 then 'magic' when 5 then 'index range' when 6 then 'crc' end as error from u where k in (3, 5, 6)""")
def container_errors(spark, sf_dir):
    """The first error of each file that has one."""
    files = stage(faulty_files(spark, sf_dir), "files")
    found = container.headers(files).where("error is not null").select("path", "error")
    chunks = container.chunks(files.join(found, "path", "left_anti")).where("error is not null")
    return found.unionByName(chunks.groupBy("path").agg(F.min_by("error", "seq").alias("error")))


@query("""
with u as (select distinct cast(user_id as varchar) as path, user_id % 8 as k from events)
select path, case k when 1 then 'unknown type' when 2 then 'video gap' end as rule, 1::bigint as n from u where k in (1, 2)""")
def container_faults(spark, sf_dir):
    """Rules that the chunks of readable files break."""
    files = stage(faulty_files(spark, sf_dir).where("cast(path as long) % 8 not in (3, 5, 6)"), "files")
    return container.timeline_faults(stage(container.chunks(files), "chunks"), container.headers(files))


@query("""
with u as (select distinct cast(user_id as varchar) as path, user_id % 8 as k from events)
select path, 'unknown type' as rule, 'XYZW' as subject from u where k = 1
union all select path, 'required', 'seek-index' from u where k = 4
union all select path, 'declaration', 'seek-index' from u where k = 4""")
def registry_faults(spark, sf_dir):
    """Rules of the registry that readable files break."""
    files = stage(faulty_files(spark, sf_dir).where("cast(path as long) % 8 not in (3, 5, 6)"), "files")
    return validation.registry_faults(stage(container.chunks(files), "chunks"), container.headers(files))


@query("""
with t as (select conv_id as path, row_number() over (partition by conv_id order by turn, role, text) as seq, case when role = 'user' then 'AURN' else 'SILN' end as type, length(text) as duration, turn, text, role from conversations),
r as (select *, coalesce(sum(duration) over (partition by path order by seq rows between unbounded preceding and 1 preceding), 0) + case when turn % 7 = 3 then 5 else 0 end as timestamp,
    case when turn % 5 = 2 then 1 else 0 end as payload_bytes from t),
l as (select * from r where path in (select path from r where type = 'AURN')),
d as (select *, coalesce(lag(timestamp + duration) over (partition by path order by seq), 0) as due from l)
select path, 'gap' as rule, count(*) as n from d where due <> timestamp group by path
union all select path, 'empty', count(*) from l where duration < 1 group by path
union all select path, 'payload', count(*) from l where type = 'SILN' and payload_bytes > 0 group by path
union all select path, 'coverage', 1 from l where path % 3 = 0 group by path""")
def audio_faults(spark, sf_dir):
    """Rules of the audio line that dialogues, read as runs and silences, break."""
    rows = _audio_rows(spark, sf_dir)
    totals = rows.groupBy("path").agg((F.sum("duration") + F.when(F.col("path") % 3 == 0, 1).otherwise(0)).alias("total"))
    return validation.audio_faults(rows, totals)


def _audio_rows(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    size = F.char_length("text").cast("long")
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return load(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("path"), F.row_number().over(w).alias("seq"), F.when(F.col("role") == "user", "AURN").otherwise("SILN").alias("type"), size.alias("duration"),
        (before + F.when(F.col("turn") % 7 == 3, 5).otherwise(0)).alias("timestamp"), F.when(F.col("turn") % 5 == 2, 1).otherwise(0).alias("payload_bytes"), (size * 48).alias("kept"),
    )


@query("""
select conv_id as path, cast(sum((role = 'user')::int) as bigint) as runs, cast(sum((role is null or role <> 'user')::int) as bigint) as silences,
    cast(sum(case when role = 'user' then length(text) * 48 else 0 end) as bigint) as kept_samples, cast(sum(case when role = 'user' then 0 else length(text) end) as bigint) as silence_ticks,
    cast(sum(length(text)) as bigint) as ticks from conversations group by conv_id""")
def audio_summary(spark, sf_dir):
    return validation.audio_summary(_audio_rows(spark, sf_dir))


@query("""
with s as (select l_orderkey as path, l_linenumber * 5000 + case when l_partkey % 10 = 0 then 100 else 0 end as timestamp, 2500 * (1 + l_suppkey % 3) as duration,
    24 + (l_partkey % 17 = 0)::int as cells, 1 + l_suppkey % 3 + (l_partkey % 13 = 0)::int as frames, case when l_partkey % 19 = 0 then 32 else 16 end as depth, l_partkey, l_suppkey from lineitem),
h as (select o_orderkey as path, 5000 * (3 + o_custkey % 5) as total from orders),
m as (select s.*, total, max(timestamp + duration) over (partition by path order by timestamp, timestamp + duration rows between unbounded preceding and 1 preceding) as reached from s join h using (path))
select path, 'frames' as rule, count(*) as n from m where timestamp % 2500 <> 0 group by path
union all select path, 'beyond', count(*) from m where timestamp + duration > total group by path
union all select path, 'cells', count(*) from m where cells <> 24 group by path
union all select path, 'depth', count(*) from m where depth <> 16 group by path
union all select path, 'count', count(*) from m where frames * 2500 <> duration group by path
union all select path, 'overlap', count(*) from m where timestamp < reached group by path""")
def subtitle_faults(spark, sf_dir):
    """Rules that spans made from order lines break."""
    c = F.col
    flag = lambda n: (c("l_partkey") % n == 0)
    spans = load(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("path"), (c("l_linenumber") * 5000 + F.when(flag(10), 100).otherwise(0)).alias("timestamp"), (2500 * (1 + c("l_suppkey") % 3)).alias("duration"),
        F.when(flag(17), 25).otherwise(24).alias("cells"), (1 + c("l_suppkey") % 3 + flag(13).cast("int")).alias("frames"), F.when(flag(19), 32).otherwise(16).alias("depth"),
    )
    heads = load(spark, sf_dir, "orders").select(
        c("o_orderkey").alias("path"), F.lit(2500).alias("frame_ticks"), (5000 * (3 + c("o_custkey") % 5)).alias("total"), F.lit(24).alias("grid_cells"), F.lit(16).alias("palette_depth")
    )
    return validation.subtitle_faults(spans, heads)


@query("""
with p as (select p_partkey, unnest(range(1 + p_partkey % 3)) as event_no, p_size from part where p_partkey % 10 > 0),
e as (select p_partkey, event_no, (p_size + event_no) % 7 as class_id, (p_partkey + event_no) % 20 as color, p_partkey % 65536 as x, p_size * 100 as y, p_size as intensity, event_no as radius,
    p_partkey * 1000 as lifetime, p_size - 30 as direction, p_size * 7 as spread, p_partkey * 12345 % 4294967296 as seed from p)
select *, case when class_id >= 6 or color >= 16 then 'reference' end as error from e
union all select p_partkey, -1, null, null, null, null, null, null, null, null, null, null, 'count' from part where p_partkey % 10 = 0""")
def particle_events(spark, sf_dir):
    """Records written to payloads and read again; each tenth payload is cut short."""
    k, n, size = F.col("p_partkey"), F.col("i"), F.col("p_size")
    part = load(spark, sf_dir, "part").select("p_partkey", "p_size")
    event = F.struct(
        ((size + n) % 7).alias("class_id"), ((k + n) % 20).alias("color"), (k % 65536).alias("x"), (size * 100).alias("y"), size.alias("intensity"), n.alias("radius"),
        (k * 1000).alias("lifetime"), (size - 30).alias("direction"), (size * 7).alias("spread"), (k * 12345 % (1 << 32)).alias("seed"),
    )
    each = part.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), k % 3))).select("p_partkey", "i", validation.particle_payload(event).alias("h"))
    joined = each.groupBy("p_partkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]), "").alias("h"), F.count("*").alias("n"))
    raw = F.unhex(F.concat(F.lpad(F.hex("n"), 2, "0"), "h"))
    payloads = joined.select("p_partkey", F.when(k % 10 == 0, F.substring(raw, 1, 15)).otherwise(raw).alias("payload"))
    return validation.particle_events(payloads, ["p_partkey"], "payload", F.lit(16))


@query("""
with n as (select p_partkey // 2 as path, p_partkey, p_size, case when p_partkey % 9 = 0 then 'other' else 'profile-1' end as f from part),
v as (select *, count(*) over (partition by path) as profiles from n where f = 'profile-1')
select path, case when p_size % 2 = 0 then 32 else 48 end as glyphs, 'balanced' as target, case when p_size % 5 = 0 then '30' else '24' end as cadence, p_size % 3 > 0 as scene_cuts,
    p_size as group_frames, true as dictionary, profiles, case when profiles > 1 then 'several' when p_size % 2 = 1 or p_size % 5 = 0 then 'invalid' end as error from v""")
def encoder_profiles(spark, sf_dir):
    """Profiles read from JSON notes; a file with two, or with fields that disagree, has an error."""
    size, k = F.col("p_size"), F.col("p_partkey")
    policy = F.struct((size % 3 > 0).alias("sceneCutAware"), F.lit(120_000).cast("long").alias("maximumTicks"), size.alias("maximumFrames"))
    note = F.struct(
        F.when(k % 9 == 0, "other").otherwise("profile-1").alias("format"), F.lit(64).alias("sourceAlphabetGlyphs"), F.when(size % 2 == 0, 32).otherwise(48).alias("glyphCount"), F.lit("balanced").alias("targetMode"),
        F.when(size % 5 == 0, "30").otherwise("24").alias("cadence"), F.lit(7).alias("cadenceId"), policy.alias("groupPolicy"), F.lit(True).alias("dictionary"),
    )
    notes = load(spark, sf_dir, "part").select(F.expr("p_partkey div 2").alias("path"), F.to_json(note).alias("note"))
    return validation.encoder_profiles(notes, "path", "note", "profile-1", [(i, label) for i, label, *_ in CADENCES])


@query("select doc_id, cast(octet_length(encode(text)) as bigint) as raw_bytes, true as exact from documents")
def huffman_round_trip(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("raw"))
    return codec.byte_code(docs, "raw", ["doc_id"]).select("doc_id", "raw_bytes", "exact")


@query(None)
def huffman_sizes(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("raw"))
    return codec.byte_code(docs, "raw", ["doc_id"])

"""Cells, planes, codebooks, sets and rule checks over the ordinary tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickplane.operators import cells as ce
from tickplane.operators import measures as ms
from tickplane.plans.registry import query
from tickplane.tables import load


@query("""
with p as (select vec_id as code, embedding as c from embeddings where vec_id < 16),
d as (select e.vec_id, p.code, round(list_sum(list_transform(list_zip(e.embedding, p.c), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))), 6) as distance
    from embeddings e, p),
r as (select *, row_number() over (partition by vec_id order by distance, code) as k from d)
select vec_id, code, distance from r where k = 1""")
def nearest_palette(spark, sf_dir):
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    book = vectors.where("vec_id < 16").select(F.col("vec_id").alias("code"), F.col("embedding").alias("code_vector"))
    return ce.nearest_code(vectors, "embedding", book, "code", "code_vector").select("vec_id", "code", "distance")


@query("""
with m as (select p_partkey, (p_partkey * 2654435761) % 65536 as mask from part),
s as (select p_partkey as id, mask from m where p_partkey <= 32),
d as (select m.p_partkey, id, bit_count(xor(m.mask, s.mask)) as h from m, s),
r as (select *, row_number() over (partition by p_partkey order by h, id) as k from d)
select p_partkey, id as nearest, cast(h as bigint) as hamming from r where k = 1""")
def glyph_subset(spark, sf_dir):
    masks = load(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") * F.lit(2654435761)) % 65536).alias("mask"))
    subset = masks.where("p_partkey <= 32").select(F.col("p_partkey").alias("id"), F.col("mask").alias("subset_mask"))
    return ce.nearest_mask(masks, "mask", subset, "id", "subset_mask").select("p_partkey", "nearest", "hamming")


@query("""
with b as (select s_suppkey, s_nationkey, s_acctbal from supplier), u as (select s_suppkey, 0 as s_nationkey, s_acctbal * 2 as s_acctbal from supplier where s_suppkey % 3 = 0)
select b.s_suppkey, case when u.s_suppkey is null then b.s_nationkey else u.s_nationkey end as s_nationkey,
    case when u.s_suppkey is null then b.s_acctbal else u.s_acctbal end as s_acctbal, u.s_suppkey is not null as covered from b left join u using (s_suppkey)""")
def plane_overlay(spark, sf_dir):
    base = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    upper = base.where("s_suppkey % 3 = 0").select("s_suppkey", F.lit(0).alias("s_nationkey"), (F.col("s_acctbal") * 2).alias("s_acctbal"))
    return ce.overlay(base, upper, ["s_suppkey"], ["s_nationkey", "s_acctbal"])


_PLANES = """
with f as (select o_custkey as c, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as f from orders),
p as (select c, f, l_suppkey as cell, sum(l_quantity) as q from f join lineitem on l_orderkey = o_orderkey group by all)"""


def _planes(spark, sf_dir):
    frames = load(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c"), "o_orderkey", (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1).cast("long").alias("f")
    )
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("cell"), "l_quantity")
    return frames.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("c", "f", "cell").agg(F.sum("l_quantity").alias("q"))


@query(
    _PLANES
    + """
, m as (select c, max(f) as last from p group by c),
o as (select p.c, p.f + 1 as f, cell, q from p join m using (c) where p.f + 1 <= last),
j as (select coalesce(p.c, o.c) as c, coalesce(p.f, o.f) as f, coalesce(p.cell, o.cell) as cell,
    case when p.cell is null then 'remove' when o.cell is null or p.q is distinct from o.q then 'upsert' end as change
    from p full join o on p.c = o.c and p.f = o.f and p.cell = o.cell)
select * from j where change is not null"""
)
def plane_delta(spark, sf_dir):
    return ce.plane_delta(_planes(spark, sf_dir), ["c"], "f", "cell", ["q"])


@query(_PLANES + " select c, cell, count(distinct f) as support from p group by c, cell having count(distinct f) >= 2")
def cell_support(spark, sf_dir):
    return ce.support(_planes(spark, sf_dir), ["c"], "f", "cell", 2)


@query(
    _PLANES
    + """
, s as (select c, cell, count(distinct f) as support from p group by c, cell),
r as (select p.c, p.f, p.cell, row_number() over (partition by p.c, p.f order by support desc, p.cell) as k from p join s on s.c = p.c and s.cell = p.cell)
select c, f, cell from r where k <= 3"""
)
def support_fill(spark, sf_dir):
    planes = _planes(spark, sf_dir)
    ranked = planes.join(ce.support(planes, ["c"], "f", "cell", 1), ["c", "cell"])
    return ce.filled(ranked, ["c", "f"], [F.col("support").desc(), F.col("cell")], 3).select("c", "f", "cell")


@query("""
with o as (select *, row_number() over w = 1 as first, lag(o_orderstatus) over w as s, lag(o_orderpriority) over w as p
    from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey))
select o_orderkey, case when first then 'all' when o_orderstatus is distinct from s and o_orderpriority is distinct from p then 'o_orderstatus+o_orderpriority'
    when o_orderstatus is distinct from s then 'o_orderstatus' when o_orderpriority is distinct from p then 'o_orderpriority' else 'none' end as change from o""")
def component_change(spark, sf_dir):
    return ce.component_change(load(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_orderpriority"]).select("o_orderkey", "change")


_GRID = """
with recursive g as (select c_nationkey::bigint as y, cast(floor(c_acctbal / 100) as bigint) as x from customer group by all having count(*) >= 2),
n as (select y, x, y * 2147483648 + x as node from g),
l as (select a.node as a, b.node as b from n a join n b on abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1),
r as (select a, b from l union select r.a, l.b from r join l on l.a = r.b),
k as (select a as node, min(b) as component from r group by a)"""


def _grid(spark, sf_dir):
    """One frame of cells."""
    cells = load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("y"), F.floor(F.col("c_acctbal") / 100).cast("long").alias("x")).count()
    return cells.where("count >= 2").withColumn("frame", F.lit(0))


@query(_GRID + " select y, x, component from n join k using (node)")
def box_components(spark, sf_dir):
    return ce.grid_components(_grid(spark, sf_dir), ["frame"], "y", "x").drop("frame")


@query(
    _GRID
    + """
select component, min(y) as top, max(y) as bottom, min(x) as "left", max(x) as "right", count(*) as cells, count(distinct y) as used_rows,
    count(distinct x) as used_columns, round(count(*) / ((max(y) - min(y) + 1) * (max(x) - min(x) + 1)), 6) as fill
from n join k using (node) group by component"""
)
def component_boxes(spark, sf_dir):
    return ce.boxes(ce.grid_components(_grid(spark, sf_dir), ["frame"], "y", "x"), ["component"], "y", "x")


@query("""
with recursive g as (select distinct user_id, event_id // 2500 as frame, cast(floor(value / 10) as bigint) as y, event_id % 40 as x from events),
n as (select user_id, frame, y, x, y * 2147483648 + x as node from g),
l as (select a.user_id, a.frame, a.node as a, b.node as b from n a join n b on a.user_id = b.user_id and a.frame = b.frame and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 3),
r as (select * from l union select r.user_id, r.frame, r.a, l.b from r join l on l.user_id = r.user_id and l.frame = r.frame and l.a = r.b),
k as (select user_id, frame, a as node, min(b) as component from r group by all)
select user_id, frame, y, x, component from n join k using (user_id, frame, node)""")
def frame_components(spark, sf_dir):
    """Components of every stream's every frame, cells up to two columns apart joined."""
    cells = load(spark, sf_dir, "events").select("user_id", F.expr("event_id div 2500").alias("frame"), F.floor(F.col("value") / 10).cast("long").alias("y"), F.pmod("event_id", F.lit(40)).alias("x"))
    return ce.grid_components(cells, ["user_id", "frame"], "y", "x", 2)


@query("""
with t as (select conv_id, turn, list_distinct(string_split(lower(text), ' ')) as w, lag(list_distinct(string_split(lower(text), ' '))) over (partition by conv_id order by turn, role) as b from conversations)
select conv_id, turn, round(len(list_intersect(w, b)) / len(list_distinct(w || b)), 6) as similarity from t where b is not null""")
def set_similarity(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.array_distinct(F.split(F.lower("text"), " ")).alias("w"))
    met = turns.withColumn("b", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn", "role"))).where("b is not null")
    return met.select("conv_id", "turn", F.round(ce.jaccard(F.col("w"), F.col("b")), 6).alias("similarity"))


@query(_PLANES + """
select c, cast(floor(f / 4) as bigint) as span, count(distinct cell) as cells, array_to_string(list_sort(list_distinct(list(cell))), ' ') as members from p group by all""")
def union_of_cells(spark, sf_dir):
    """The union of the cells of each four frames."""
    return ce.union_of_cells(_planes(spark, sf_dir).withColumn("span", F.floor(F.col("f") / 4).cast("long")), ["c", "span"], "cell").select(
        "c", "span", F.size("members").cast("long").alias("cells"), F.array_join(F.col("members").cast("array<string>"), " ").alias("members")
    )


@query("""
select distinct lang, source from documents d
where not exists (select 1 from documents x join labels l using (doc_id) where l.toxic = 1 and x.lang = d.lang and x.source = d.source)""")
def missing_classes(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    toxic = docs.join(load(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id").select("lang", "source")
    return docs.select("lang", "source").distinct().join(toxic, ["lang", "source"], "left_anti")


@query("""
with r as (select doc_id, source, row_number() over (partition by text order by doc_id) as k from documents) select doc_id, source from r where k = 1""")
def queue_dedupe(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h"), "doc_id", "source")
    return ms.least_by(docs, ["h"], ["doc_id"], ["doc_id", "source"]).drop("h")


@query("""
select 'discount range' as rule, count(*) as violations from lineitem where not l_discount between 0 and 0.1
union all select 'quantity positive', count(*) from lineitem where not l_quantity > 0
union all select 'label binary', count(*) from labels where toxic not in (0, 1) or quality not in (0, 1)
union all select 'label orphan', count(*) from labels l where not exists (select 1 from documents d where d.doc_id = l.doc_id)
union all select 'nation known', count(*) from customer c where not exists (select 1 from nation n where n.n_nationkey = c.c_nationkey)
union all select 'line shipped after order', count(*) from lineitem join orders on o_orderkey = l_orderkey where l_shipdate < o_orderdate""")
def violations(spark, sf_dir):
    lines, labels = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "labels")
    rule = lambda name, rows: rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")
    docs, nations = load(spark, sf_dir, "documents").select("doc_id"), load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
    early = lines.select("l_orderkey", "l_shipdate").join(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    found = [
        rule("discount range", lines.where(~F.col("l_discount").between(0, 0.1))),
        rule("quantity positive", lines.where(~(F.col("l_quantity") > 0))),
        rule("label binary", labels.where(~F.col("toxic").isin(0, 1) | ~F.col("quality").isin(0, 1))),
        rule("label orphan", labels.join(docs, "doc_id", "left_anti")),
        rule("nation known", load(spark, sf_dir, "customer").join(nations, "c_nationkey", "left_anti")),
        rule("line shipped after order", early.where("l_shipdate < o_orderdate")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@query("""
select event_type, json_extract_string(props, '$.k') as k, count(*) as n from events group by all""")
def profile_json(spark, sf_dir):
    profile = F.from_json("props", "k string")
    return load(spark, sf_dir, "events").groupBy("event_type", profile["k"].alias("k")).agg(F.count("*").alias("n"))


@query("""
select n_name, r_name, count(*) as customers from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by all""")
def codebook_lookup(spark, sf_dir):
    nations = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return load(spark, sf_dir, "customer").groupBy("c_nationkey").count().join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "r_name", F.col("count").alias("customers"))


@query("""
select l_orderkey, l_partkey, 'no order' as fault from lineitem where not exists (select 1 from orders where o_orderkey = l_orderkey)
union all select o_orderkey, null, 'no line' from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)""")
def index_targets(spark, sf_dir):
    lines, orders = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    lost = lines.join(orders, "l_orderkey", "left_anti").withColumn("fault", F.lit("no order"))
    idle = orders.join(lines.select("l_orderkey"), "l_orderkey", "left_anti").select("l_orderkey", F.lit(None).cast("long").alias("l_partkey"), F.lit("no line").alias("fault"))
    return lost.unionByName(idle)

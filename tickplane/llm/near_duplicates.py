"""Near-duplicate groups: MinHash bands, sequential Bayesian pruning, exact links.

1. Each text becomes its set of k-word shingles, a 128-bit fingerprint of that
   set and a MinHash signature (one pass, Arrow batches).  Texts with equal sets
   are one node from here on, so a group of copies costs one row.
2. Signature bands deal nodes to buckets.  A bucket's least node is compared
   with the others of the bucket: a star, never all pairs.
3. A candidate's signatures are compared a batch at a time; it is pruned as soon
   as the posterior probability that its similarity reaches the threshold is
   below ``miss``.  Survivors are linked only by their full sets.
4. Components of the links are contracted, a few bands after the other.  Buckets
   that still hold nodes of several components are searched between the
   components, so a link that no star saw is found as well.  Most of such a
   bucket is one component, its hub; the others meet the hub and each other in
   blocks of bounded bytes.  A pair is looked at in the first band that it
   shares, and a block returns links that connect its components, not its pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickplane.llm.textkernel import mix64, shingle_sets, text_chunks, tidy, words
from tickplane.operators.components import connected_components
from tickplane.operators.prefilter import maybe_among
from tickplane.tables import stage, unstage

MISS = 1e-6
MAX_HASHES = 128
#: Hashes compared between two looks at the posterior.
BATCH = 24
#: Bytes of signatures and shingle sets in a block of a bucket.
BLOCK_BYTES = 1 << 20

_PERMUTATIONS = np.random.default_rng(7).integers(0, 1 << 63, MAX_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def plan_bands(threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(rows, bands): the longest bands of at most MAX_HASHES hashes in all that
    pass over a pair at the threshold with probability ``miss`` or less."""
    for rows in range(16, 0, -1):
        chance = threshold**rows
        bands = 1 if chance >= 1 else math.ceil(math.log(miss) / math.log1p(-chance))
        if rows * bands <= MAX_HASHES:
            return rows, bands
    raise ValueError("the threshold is too low for this many hashes")


def least_matches(n: int, threshold: float, miss: float) -> int:
    """Fewest matches among n hashes that leave P(similarity >= threshold) >= miss.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper
    tail at t is P(Binomial(n + 1, t) <= m).
    """
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def signatures(texts: pa.Array, k: int, hashes: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Set sizes, set fingerprints and 16-bit MinHash signatures of a column."""
    sizes, prints, rows = [], [], []
    for part in text_chunks(texts):
        sets, bounds = shingle_sets(words(part), k)
        size = np.diff(bounds)
        sizes.append(size)
        cuts = bounds.tolist()
        raw = sets.tobytes()
        prints += [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        sig = np.zeros((len(size), hashes), np.uint16)
        full = size > 0
        if full.any():
            starts = bounds[:-1][full]
            spun = np.empty_like(sets)
            for i in range(hashes):
                np.multiply(sets, _PERMUTATIONS[i], out=spun)
                sig[full, i] = mix64(np.minimum.reduceat(spun, starts)).astype(np.uint16)
        rows.append(sig)
    if not sizes:
        return np.zeros(0, np.int64), [], np.zeros((0, hashes), np.uint16)
    return np.concatenate(sizes), prints, np.concatenate(rows)


def _sketch(docs: DataFrame, id_col: str, text_col: str, k: int, hashes: int) -> DataFrame:
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("n", T.LongType()), T.StructField("print", T.BinaryType()), T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, prints, sig = signatures(batch.column(1), k, hashes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary())], ["id", "n", "print", "sig"]
            )

    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)


def _sets(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, grams): sorted distinct shingle hashes of each text."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("grams", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch.column(1)):
                sets, bounds = shingle_sets(words(part), k)
                grams = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(part)), grams], ["id", "grams"])

    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)


def prune(candidates: DataFrame, threshold: float, miss: float, hashes: int) -> DataFrame:
    """Keep the pairs (a, b, sig_a, sig_b) that no look at the posterior rules out."""
    looks = [(n, least_matches(n, threshold, miss)) for n in [*range(BATCH, hashes, BATCH), hashes]]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, hashes) for c in (2, 3))
            alive, matches, seen = np.arange(len(left)), np.zeros(len(left), np.int64), 0
            for upto, least in looks:
                matches = matches + (left[alive, seen:upto] == right[alive, seen:upto]).sum(1)
                keep = matches >= least
                alive, matches, seen = alive[keep], matches[keep], upto
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive))], ["a", "b"])

    return candidates.select("a", "b", "sig_a", "sig_b").mapInArrow(tidy(run), T.StructType([candidates.schema["a"], candidates.schema["b"]]))


def _with_signatures(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Join signatures to pairs; pairs whose sizes alone rule out a link go first."""
    side = lambda x: nodes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def _sets_of(asked: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """Staged shingle sets of the asked ids, made again from their texts.

    A bit table keeps texts that nobody asks for out of the join's shuffle.
    """
    asked = stage(asked.distinct(), "asked")
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    some = maybe_among(some, "id", asked, "id", asked.count()).join(asked, "id")
    sets = stage(_sets(some, "id", "text", k).distinct(), "sets")
    unstage(asked)
    return sets


def _verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold, staged.

    One text may be in very many pairs: that is a skewed inner join, which Spark
    splits.
    """
    pairs = stage(pairs, "survivors")
    sets = _sets_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), docs, id_col, text_col, k)
    side = lambda x: sets.select(F.col("id").alias(x), F.col("grams").alias(f"grams_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("common", F.size(F.array_intersect("grams_a", "grams_b")))
    links = both.where(100 * F.col("common") >= percent * (F.size("grams_a") + F.size("grams_b") - F.col("common"))).select("a", "b")
    links = stage(links.distinct(), "links")
    unstage(sets)
    unstage(pairs)
    return links


class _Between:
    """Candidate pairs of different components inside one block of a bucket."""

    def __init__(self, threshold: float, miss: float, hashes: int):
        self.looks = [(n, least_matches(n, threshold, miss)) for n in [*range(BATCH, hashes, BATCH), hashes]]
        self.rows, self.hashes = plan_bands(threshold, miss)[0], hashes

    def pairs(self, group: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        """For each row of the block's own side the rows of the other side that survive all looks.

        Both sides of a block with itself are the same rows, each pair once.  A
        pair that shares an earlier band is left to that band's bucket.
        """
        sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint16).reshape(-1, self.hashes)
        part, comp = group["part"].to_numpy(), group["component"].combine_chunks().dictionary_encode().indices.to_numpy()
        i, j, before = group["i"][0].as_py(), group["j"][0].as_py(), self.rows * group["band"][0].as_py()
        mine, others = np.flatnonzero(part == i), np.flatnonzero(part == j)
        for place, row in enumerate(mine.tolist()):
            rest = others[place + 1 :] if i == j else others
            rest = rest[comp[rest] != comp[row]]
            matches, seen = np.zeros(len(rest), np.int64), 0
            for upto, least in self.looks:
                if not len(rest):
                    break
                matches = matches + (sig[rest, seen:upto] == sig[row, seen:upto]).sum(1)
                keep = matches >= least
                rest, matches, seen = rest[keep], matches[keep], upto
            if before and len(rest):
                met = (sig[rest, :before] == sig[row, :before]).reshape(len(rest), -1, self.rows).all(2).any(1)
                rest = rest[~met]
            if len(rest):
                yield row, rest


def _dealt(members: DataFrame, mixed: DataFrame) -> DataFrame:
    """Deal the rows of mixed buckets to groups (band, key, i, j), blocks ``part`` i and j of a bucket.

    A bucket's hub is its component of most bytes, and is cut into the blocks
    -1, -2, ...; the other components' rows into 0, 1, ...  Blocks of others meet
    all blocks, those of the hub only others: with h and o blocks of either kind
    a hub row is dealt o times and another o + h times.  Near copies are one
    component but for a few, so that is in proportion to the bucket.
    """
    met = members.join(mixed, ["band", "key"])
    in_hub = F.col("component") == F.col("hub")
    blocks = F.when(in_hub, F.col("hub_blocks")).otherwise(F.col("other_blocks"))
    cut = met.withColumn("part", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("part", F.when(in_hub, -1 - F.col("part")).otherwise(F.col("part")))
    others = F.sequence(F.lit(0), F.col("other_blocks") - 1)
    partners = F.when(in_hub, others).otherwise(F.concat(others, F.transform(F.sequence(F.lit(1), F.col("hub_blocks")), lambda x: -x)))
    return cut.withColumn("other", F.explode(partners)).withColumn("i", F.greatest("part", "other")).withColumn("j", F.least("part", "other"))


def _mixed(members: DataFrame) -> DataFrame:
    """(band, key, hub, hub_blocks, other_blocks) of the buckets with several components."""
    parts = members.groupBy("band", "key", "component").agg(F.sum("weight").alias("bytes"))
    hubs = parts.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("bytes").alias("all"), F.max(F.struct("bytes", "component")).alias("hub")).where("n > 1")
    blocks = lambda size: F.ceil(size / BLOCK_BYTES).cast("int")
    return hubs.select("band", "key", F.col("hub.component").alias("hub"), blocks(F.col("hub.bytes")).alias("hub_blocks"), blocks(F.col("all") - F.col("hub.bytes")).alias("other_blocks"))


def _links_between(members: DataFrame, nodes: DataFrame, find: _Between, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """Every link between components inside the buckets, up to what connects them.

    First the nodes with a surviving partner are found by signatures alone; only
    they get their sets, and each group then returns verified links that connect
    its components, at most one for each row, never a group's pairs.
    """
    id_type = nodes.schema["id"].dataType
    columns = ["band", "key", "i", "j", "part", "id", "component", "sig"]
    weight = 2 * find.hashes + 8 * F.col("n")
    members = stage(members.select("band", "key", "id", "component").join(nodes.select("id", weight.alias("weight")), "id"), "member")
    dealt = _dealt(members, _mixed(members)).join(nodes.select("id", "sig"), "id").select(*columns)

    def suspects(group: pa.Table) -> pa.Table:
        hit = np.zeros(len(group), bool)
        for row, rest in find.pairs(group):
            hit[row] = True
            hit[rest] = True
        return group.filter(pa.array(hit))

    schema = T.StructType([dealt.schema[c] for c in columns])
    found = stage(dealt.groupBy("band", "key", "i", "j").applyInArrow(suspects, schema), "suspects")
    sets = _sets_of(found.select("id"), docs, id_col, text_col, k)

    def connect(group: pa.Table) -> pa.Table:
        ids, comp = group["id"].combine_chunks(), group["component"].to_pylist()
        lists = group["grams"].combine_chunks()
        bounds, grams = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        parent = {c: c for c in comp}

        def root(c):
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        links = [[], []]
        for row, rest in find.pairs(group):
            own = grams[bounds[row] : bounds[row + 1]]
            for other in rest.tolist():
                x, y = root(comp[row]), root(comp[other])
                if x == y:
                    continue
                theirs = grams[bounds[other] : bounds[other + 1]]
                at = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
                common = int((own[at] == theirs).sum())
                if 100 * common >= percent * (len(own) + len(theirs) - common):
                    parent[x] = y
                    links[0].append(row)
                    links[1].append(other)
        return pa.Table.from_arrays([ids.take(pa.array(x, pa.int64())) for x in links], ["a", "b"])

    whole = found.join(sets, "id").select(*columns, "grams")
    schema = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type)])
    links = stage(whole.groupBy("band", "key", "i", "j").applyInArrow(connect, schema).distinct(), "links")
    for done in (members, found, sets):
        unstage(done)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, k: int = 5, miss: float = MISS) -> DataFrame:
    """Group documents whose shingle sets are at least ``percent`` % similar.

    Returns (id_col, n_shingles, component_id, kept), one row per input row:
    ``component_id`` is the least id reachable over links, ``kept`` says whether
    that is the row's own id.  Texts that are null, empty or without words have
    no shingles and are alone.  Texts of fewer than k words have their whole word
    sequence as one shingle.  Repeated rows share a component.  A row without an
    id has a null component and is not kept.  An empty table gives an empty
    result; further columns are ignored.

    A link is missed with probability ``miss`` at the threshold, less above it.
    """
    threshold = percent / 100
    rows, bands = plan_bands(threshold, miss)
    hashes = rows * bands
    id_type = docs.schema[id_col].dataType
    sketch = stage(_sketch(docs, id_col, text_col, k, hashes), "sketch")
    nodes = stage(
        sketch.where("n > 0 and id is not null").groupBy("print").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")), "nodes"
    )
    in_bands = nodes.select(
        "id", F.posexplode(F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 2 * rows * i + 1, 2 * rows)) for i in range(bands)])).alias("band", "key")
    )
    buckets = stage(in_bands.groupBy("band", "key").agg(F.min("id").alias("first"), F.count("*").alias("size")).where("size > 1"), "buckets")
    members = stage(in_bands.join(buckets, ["band", "key"]).where("id <> first"), "members")
    unstage(buckets)

    links = labels = None

    def labelled(rows: DataFrame, column: str, to: str) -> DataFrame:
        if labels is None:
            return rows.withColumn(to, F.col(column))
        return rows.join(labels.select(F.col("node").alias(column), F.col("component").alias(to)), column, "left").withColumn(to, F.coalesce(to, column))

    def contract(more: DataFrame) -> None:
        """Take further links into the components."""
        nonlocal links, labels
        if not more.isEmpty():
            links = more if links is None else links.unionByName(more)
            old, labels = labels, stage(connected_components(links), "labels")
            if old is not None:
                unstage(old)

    # Stars, first of a few bands, so that a group of near copies is contracted
    # before its other bands are looked at.
    some = max(1, bands // 8)
    for low, high in ((0, some - 1), (some, bands - 1)):
        star = members.where(F.col("band").between(low, high)).select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
        star = labelled(labelled(star, "a", "x"), "b", "y").where("x <> y")
        sized = _with_signatures(star, nodes).where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
        contract(_verified(prune(sized, threshold, miss, hashes), docs, id_col, text_col, k, percent))

    # The least node of a bucket has met all others; what is left is between the others.
    left = labelled(members.where("size > 2"), "id", "component")
    contract(_links_between(left, nodes, _Between(threshold, miss, hashes), docs, id_col, text_col, k, percent))
    unstage(members)

    if labels is None:
        labels = nodes.where("false").select(F.col("id").alias("node"), F.col("id").alias("component"))
    per_print = nodes.join(labels, nodes["id"] == labels["node"], "left").select("print", F.coalesce("component", "id").alias("component"))
    return sketch.join(per_print, "print", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(False)).alias("kept"),
    )

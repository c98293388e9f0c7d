"""Near duplicates, decontamination and licence alignment against brute force."""

import itertools
import random
from datetime import date
from decimal import Decimal

import numpy as np
import pytest

from tickplane.llm import decontamination as dc
from tickplane.llm import licenses as lic
from tickplane.llm import near_duplicates as nd
from tickplane.llm.textkernel import joined, words

VOCABULARY = [f"w{i}" for i in range(400)]


def ascii_words(text):
    out, word = [], ""
    for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text) + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def shingles(text, k=5):
    w = ascii_words(text or "")
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows, percent):
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return {i: root(i) for i in parent}


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
    return " ".join(w)


@pytest.mark.parametrize("percent", [80, 85])
def test_components_match_brute_force(spark, percent):
    rng = random.Random(percent)
    rows = []
    for _ in range(30):
        base = " ".join(rng.choice(VOCABULARY) for _ in range(rng.choice((4, 12, 60, 200))))
        rows += [(len(rows) + i, t) for i, t in enumerate([base, base.upper(), edited(rng, base, 1), edited(rng, base, 2), edited(rng, base, 5)])]
    hot = " ".join(rng.choice(VOCABULARY) for _ in range(150))
    rows += [(1000 + i, edited(rng, hot, rng.randrange(0, 5))) for i in range(120)]
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one two"), (2004, "ONE\ttwo"), (2005, "one two "), (2006, "x " * 30000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in nd.near_duplicates(df, percent=percent).collect()}
    expected = components(rows, percent)
    assert {i: r["component_id"] for i, r in got.items()} == expected
    assert all(r["n_shingles"] == len(shingles(t)) for (i, t) in rows for r in [got[i]])
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_links_that_no_star_sees(spark):
    """A chain whose ends are far apart is one component."""
    rng = random.Random(4)
    text = [rng.choice(VOCABULARY) for _ in range(300)]
    rows = []
    for i in range(40):
        rows.append((i * 7 % 40, " ".join(text)))
        text[rng.randrange(300)] = rng.choice(VOCABULARY)
        text[rng.randrange(300)] = rng.choice(VOCABULARY)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(df).collect()} == components(rows, 85)


def test_block_search_connects_all(spark):
    """Groups of near copies in one bucket are joined between blocks, with fewer links than rows."""
    rng = random.Random(9)
    base = " ".join(rng.choice(VOCABULARY) for _ in range(120))
    rows = [(i, edited(rng, base, 1)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rows_, bands = nd.plan_bands(0.85)
    hashes = rows_ * bands
    from pyspark.sql import functions as F

    sketch = nd._sketch(docs, "doc_id", "text", 5, hashes).cache()
    nodes = sketch.select("id", "n", "sig")
    members = nodes.select(F.lit(0).alias("band"), F.lit(1).cast("long").alias("key"), F.lit(1 << 12).cast("long").alias("size"), "id", F.col("id").alias("component"))
    links = [tuple(r) for r in nd._links_between(members, nodes, nd._Between(0.85, 1e-6, hashes), docs, "doc_id", "text", 5, 85).collect()]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    expected = components(rows, 85)
    assert len({root(i) for i in parent}) == len(set(expected.values()))


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c d e f", "x"), (3, "a b c d e f", "y"), (3, "a b c d e f", "y"), (5, "A B C D E F", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["kept"]) for r in nd.near_duplicates(df).collect())
    assert got == [(False, 3, True), (False, 3, True), (False, 5, False), (True, 0, False)]
    assert nd.near_duplicates(df.where("doc_id > 99")).count() == 0


def test_pruning_bound_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    for n in (24, 48, 120):
        least = nd.least_matches(n, 0.85, 1e-6)
        assert (rng.binomial(n, 0.85, 200_000) < least).mean() < 1e-4
        assert least > 0.4 * n


def test_bands_reach_the_miss_probability():
    for t in (0.8, 0.85, 0.9):
        rows, bands = nd.plan_bands(t)
        assert (1 - t**rows) ** bands <= nd.MISS and rows * bands <= nd.MAX_HASHES


def weighted_jaccard(a, b):
    from collections import Counter

    x, y = Counter(a), Counter(b)
    shared = sum((x & y).values())
    return shared / (sum(x.values()) + sum(y.values()) - shared)


def brute_leaks(text, items):
    w, out = ascii_words(text or ""), {}
    for item, body in items:
        v = ascii_words(body or "")
        k = min(5, len(v))
        grams = lambda s: [tuple(s[i : i + k]) for i in range(len(s) - k + 1)]
        for at in range(len(w) - len(v) + 1) if v else ():
            s = weighted_jaccard(grams(w[at : at + len(v)]), grams(v))
            if s >= dc.THRESHOLD - 1e-12 and s > out.get(item, (0, 0))[0] + 1e-12:
                out[item] = (s, at)
    return out


def test_leaks_match_brute_force(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    items = [(i, say(rng.choice((1, 3, 5, 9, 20, 40)))) for i in range(25)] + [(90, None), (91, " "), (92, "w1 w1 w1 w1 w1 w1 w1 w1")]
    rows = []
    for i in range(60):
        _, body = items[rng.randrange(25)]
        parts = [say(rng.randrange(0, 30)), body if i % 3 else edited(rng, body, 1 + i % 2), say(rng.randrange(0, 30))]
        rows.append((i, ("\n" if i % 2 else "  ").join(parts)))
    rows += [(100, None), (101, ""), (102, "w1 " * 3000), (103, say(5) + " " + items[3][1].upper())]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in dc.decontaminate(docs, bench).collect():
        got.setdefault(r["doc_id"], {})[r["item_id"]] = (round(r["similarity"], 9), r["first_word"])
    expected = {i: {k: (round(s, 9), at) for k, (s, at) in brute_leaks(t, items).items()} for i, t in rows}
    assert got == {i: x for i, x in expected.items() if x}
    kept = {r["doc_id"] for r in dc.drop_contaminated(docs, bench).collect()}
    assert kept == {i for i, x in expected.items() if not x}


def test_leaks_with_nothing_to_find(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.decontaminate(docs, none).count() == 0 and dc.drop_contaminated(docs, none).count() == 1
    assert dc.decontaminate(docs.where("doc_id > 1"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


def test_block_tables_find_everything_in_the_radius():
    rng = np.random.default_rng(3)
    items = dc.Index([(i, " ".join(f"t{rng.integers(999)}" for _ in range(12))) for i in range(50)]).by_length[0]
    prints = rng.integers(0, 256, (300, dc.BITS // 8), dtype=np.uint8)
    for i in range(200):  # near ones
        near = np.unpackbits(items.prints[i % 50])
        near[rng.choice(dc.BITS, rng.integers(0, 100), replace=False)] ^= 1
        prints[i] = np.packbits(near)
    window, item = dc.candidates(items, prints)
    far = np.unpackbits(prints[:, None, :] ^ items.prints[None], axis=2).sum(2)
    assert set(zip(window.tolist(), item.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(far <= dc.RADIUS)), strict=True))


def test_blocks_select():
    """Of random windows and items under one in twenty share a near block."""
    rng = np.random.default_rng(4)
    items = dc.Index([(i, " ".join(f"t{rng.integers(999)}" for _ in range(12))) for i in range(500)]).by_length[0]
    window, item = dc.block_candidates(items, rng.integers(0, 256, (400, dc.BITS // 8), dtype=np.uint8))
    assert len(window) == len(set(zip(window.tolist(), item.tolist(), strict=True))) < 0.05 * 500 * 400


@pytest.mark.parametrize("kind, ids", [("int", [7, None]), ("string", ["seven", None]), ("decimal(9,2)", [Decimal("7.25"), None]), ("date", [date(2020, 2, 7), None])])
def test_leaks_keep_items_of_any_type(spark, kind, ids):
    text = "one two three four five six seven eight"
    bench = spark.createDataFrame([(ids[0], text), (ids[1], text + " nine")], f"item_id {kind}, text string")
    docs = spark.createDataFrame([(None, f"so {text} nine"), ("d", text), ("e", "none here")], "doc_id string, text string")
    found = dc.decontaminate(docs, bench)
    assert found.schema["item_id"].dataType == bench.schema["item_id"].dataType
    got = {(r["doc_id"], r["item_id"]) for r in found.where("similarity = 1").collect()}
    assert got == {(None, ids[0]), (None, ids[1]), ("d", ids[0])}


def test_leaks_in_several_passes(spark, monkeypatch):
    text = ["one two three four five six", "seven eight nine ten eleven twelve", "red green blue white black grey"]
    bench = spark.createDataFrame(list(enumerate(text)), "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in enumerate(text * 2)], "doc_id long, text string")
    whole = sorted(map(tuple, dc.decontaminate(docs, bench).collect()))
    monkeypatch.setattr(dc, "CHARS_PER_PASS", 30)
    assert sorted(map(tuple, dc.decontaminate(docs, bench).collect())) == whole and len(whole) == 6
    assert dc.drop_contaminated(docs, bench).count() == 0


def test_patience_matches_in_order():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randrange(0, 14))] for _ in range(2))
        got = lic.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(got))
    assert len(lic.patience(list("xaybzcd"), list("abcd"))) == 4


def test_licences_are_found_and_covered(spark):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    mit = lic.TEMPLATES["mit"]
    words_ = mit.split(" ")
    rows = [
        (1, say(40) + "\n" + mit + "\n" + say(40)), (2, mit.upper()), (3, " ".join(w for i, w in enumerate(words_) if i % 10)), (4, " ".join(words_[: len(words_) // 2])),
        (5, "öäü " + lic.TEMPLATES["mit-line"] + " x\n" + lic.TEMPLATES["mit-line"]), (6, None), (7, ""), (8, say(300)), (None, lic.TEMPLATES["cc-by-nc-4.0-line"]),
    ]
    got = lic.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["license"]) for r in got) == [(0, "cc-by-nc-4.0-line"), (1, "mit"), (2, "mit"), (3, "mit"), (5, "mit-line"), (5, "mit-line")]
    by = {r["doc_id"]: r for r in got if r["license"] == "mit"}
    assert by[1]["coverage"] == 1.0 and 0.8 <= by[3]["coverage"] < 0.95
    assert rows[0][1][by[1]["start"] : by[1]["end"]] == mit.rstrip(".")
    assert sorted(r["start"] for r in got if r["doc_id"] == 5) == [4, 38]


def test_word_kernel_matches_plain_python():
    rng = random.Random(1)
    alphabet = "aZ9é漢\U0001f600 \t\n\x0b\x0c\r\x1c  \x00"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40))) for _ in range(400)]
    part = joined([t.encode() for t in texts])
    found = words(part)
    spans = [(part.data[a:b].tobytes().decode()) for a, b in zip(found.start, found.end, strict=True)]
    lower = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s) for s in spans]
    assert [lower[a:b] for a, b in itertools.pairwise(found.bounds.tolist())] == [ascii_words(t) for t in texts]
    names = {}
    for h, w in zip(found.hash.tolist(), lower, strict=True):
        assert names.setdefault(h, w) == w
    assert len(set(names.values())) == len(names)


def test_a_large_bucket_is_dealt_in_proportion(spark):
    """A bucket of 100,000 near copies and a few others is dealt about once, not in its square."""
    from pyspark.sql import functions as F

    n, few = 100_000, 40
    rows = spark.range(n).select(F.lit(0).alias("band"), F.lit(1).alias("key"), F.col("id"), F.when(F.col("id") < few, F.col("id")).otherwise(n).alias("component"), F.lit(3000).alias("weight"))
    assert nd._mixed(rows).collect()[0]["hub"] == n
    dealt = nd._dealt(rows, nd._mixed(rows))
    sizes = dealt.groupBy("i", "j").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).agg(F.max("w"), F.sum("n")).first()
    assert sizes[1] < 1.3 * n and sizes[0] < 3 * nd.BLOCK_BYTES
    # Every two rows of different components meet in some group.
    small = spark.range(300).select(F.lit(0).alias("band"), F.lit(1).alias("key"), F.col("id"), F.least(F.lit(5), F.col("id") % 7).alias("component"), F.lit(100_000).alias("weight"))
    groups = {}
    for r in nd._dealt(small, nd._mixed(small)).collect():
        groups.setdefault((r["i"], r["j"]), []).append((r["part"], r["id"], r["component"]))
    met = {tuple(sorted((x, y))) for (i, j), own in groups.items() for p, x, a in own if p == i for q, y, b in own if q == j and a != b}
    assert met == {(x, y) for x in range(300) for y in range(x + 1, 300) if min(5, x % 7) != min(5, y % 7)}


def test_bands_search_pairs_in_their_first_band(spark):
    """Near copies that no star joins are found though each pair is looked at once."""
    rng = random.Random(21)
    base = [rng.choice(VOCABULARY) for _ in range(200)]
    rows = []
    for i in range(150):  # copies with edits of their own: many pairs are just above or below the threshold
        own = list(base)
        for at in rng.sample(range(200), rng.choice((2, 3, 4))):
            own[at] = rng.choice(VOCABULARY)
        rows.append((1000 - i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(df, percent=80).collect()} == components(rows, 80)

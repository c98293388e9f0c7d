"""Text operators against brute force, exact round trips and held-out accuracy."""

import base64
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import same_rows

from tickplane.llm import byte_bpe, chat_format, crf, language_id, pii, quality_rules, secrets, toxicity
from tickplane.llm.oracles import ORACLES
from tickplane.llm.queries import QUERIES
from tickplane.llm.spans import points
from tickplane.llm.textkernel import joined, text_chunks

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf_dir, duck, name):
    same_rows(QUERIES[name](spark, sf_dir), duck, ORACLES[name])


# Byte-level BPE ---------------------------------------------------------------


@pytest.fixture(scope="module")
def reference_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _strange_texts():
    rng = random.Random(1)
    ranges = ((0, 300), (0x20, 0x7F), (0x400, 0x500), (0x4E00, 0x4F00), (0x1F300, 0x1F900))
    return ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(60))) for _ in range(800)] + ["", " ", "\n\n", "a" * 40000, "<|endoftext|>", "⁇⁇ <unk> ▁"]


def test_bpe_encodes_as_tiktoken_and_decodes(reference_encoding):
    codec = byte_bpe.ByteBpe(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    texts = _strange_texts()
    for text, ids in zip(texts, codec.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference_encoding.encode_ordinary(text)
        assert codec.decode(ids).decode() == text


def test_bpe_query_digests(spark, sf_dir, duck, reference_encoding):
    texts = dict(duck.execute("select doc_id, text from documents").fetchall())
    for r in QUERIES["op7_byte_bpe"](spark, sf_dir).collect():
        ids = reference_encoding.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_bpe_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b", "x"), (1, None, "y"), (1, "", None)], "doc_id long, text string, ids string")
    got = byte_bpe.byte_bpe(df, RANKS, public_tokenizers.PATTERN, outputs=("ids", "n_tokens", "decoded")).collect()
    assert [(r["doc_id"], r["n_tokens"], r["decoded"]) for r in got] == [(None, 2, "a b"), (1, 0, ""), (1, 0, "")]
    assert byte_bpe.byte_bpe(df.where("doc_id = 7"), RANKS, public_tokenizers.PATTERN).count() == 0


# Spans ------------------------------------------------------------------------

PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    odd = [int(d) for d in digits[::-1][0::2]]
    even = [sum(divmod(2 * int(d), 10)) for d in digits[::-1][1::2]]
    return (sum(odd) + sum(even)) % 10 == 0


def brute_pii(text):
    out = []
    for kind, pattern in PII_PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and _luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), list(PII_PATTERNS).index(kind), kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def brute_secrets(text):
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def _scan(module, texts):
    scan, out = module.make_scan(), [[] for _ in texts]
    import pyarrow as pa

    for part in text_chunks(pa.array(texts)):
        for row, spans in scan(part).items():
            at = points(part.bytes_of(row))
            out[part.first + row] = [(k, int(at[a]), int(at[b])) for a, b, k in spans]
    return out


def _soup(pieces, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(1500)]


@pytest.mark.parametrize(
    "module, brute, pieces",
    [
        (pii, brute_pii, ["a", "é", "b.c", "@", "x@y.zz", ".", "1", "23", "255", "256", "192.168.0.1", "+", "+1 (415) 555-0100", "-", " ", "4111111111111111", "4111 1111", "0", "\n", "(", "%"]),
        (secrets, brute_secrets, ["token", "TOKEN", "ſecret", "secret", "api_key", "apikey", "password", "=", ":", " ", '"', "'", "abcdef", "0a1b2c3d4e5f", "AKIA", "ABCDEFGH12345678", "é", "\n", "passwd=", "x/y+z", "K"]),
    ],
)
def test_base_spans_match_brute_force(module, brute, pieces):
    texts = _soup(pieces, 3)
    for text, spans in zip(texts, _scan(module, texts), strict=True):
        base = [s for s in spans if s[0] in module.KINDS]
        assert base == brute(text), text
        for kind, a, b in spans:
            assert 0 <= a < b <= len(text)
            assert kind in module.KINDS or all(b <= x or a >= y for _, x, y in base)


@pytest.mark.parametrize("module, brute, name", [(pii, brute_pii, "op10_pii_scan"), (secrets, brute_secrets, "op9_secret_scan")])
def test_span_queries_match_brute_force(spark, sf_dir, duck, module, brute, name):
    texts = dict(duck.execute("select doc_id, text from documents").fetchall())
    for r in QUERIES[name](spark, sf_dir).collect():
        base = brute(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert {k: r[f"n_{k}"] for k in module.KINDS} == {k: sum(s[0] == k for s in base) for k in module.KINDS}
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(","))


def test_long_hostile_texts_are_linear():
    texts = ["1" * 200_000, "a" * 200_000, "@" * 50_000, "a@" * 50_000, "1." * 100_000, "+1" + "(" * 200_000, "token=" * 30_000, "f" * 200_000]
    for module in (pii, secrets):
        assert len(_scan(module, texts)) == len(texts)


@pytest.mark.parametrize("module", [pii, secrets])
def test_crf_learns_its_table(module):
    model, wrong, total = module.model(), 0, 0
    for line in module.TABLE.strip().splitlines():
        features, tags = crf._marked(line, model.keywords, model.file_features)
        got = crf.viterbi(crf.emissions(features, model.emit), model.trans, np.array([0, len(tags)]))
        wrong, total = wrong + int((got != tags).sum()), total + len(tags)
    assert wrong <= 0.01 * total


def test_crf_finds_what_patterns_leave_out():
    found = _scan(pii, ["the ssn 219-09-1234 was read", "Version 2.0 of 2019 has 1000 pages", "nothing here é ñ", "Licensed under CC BY-NC 4.0."])
    assert found[0] == [("personal", 8, 19)] and found[1:] == [[], [], []]
    found = _scan(secrets, ["push with ghp_Zx81kPq0vvLm92Kd7aQwErTy55Bn33Xc now", "a token of thanks and the secret is out", "plain words only"])
    assert found[0] == [("secret", 10, 46)] and found[1:] == [[], []]


def _brute_viterbi(score, trans):
    best = None
    for path in itertools.product(range(3), repeat=len(score)):
        value = sum(score[i, t] for i, t in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path))
        if best is None or value > best[0] + 1e-12:
            best = (value, path)
    return best


def test_cut_viterbi_is_exact():
    rng = np.random.default_rng(5)
    for _ in range(200):
        lengths = rng.integers(0, 7, 4)
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        score = rng.normal(0, 2, (bounds[-1], 3))
        score[rng.random(bounds[-1]) < 0.5, 0] += 6
        trans = rng.normal(0, 1, (3, 3))
        tags = crf.viterbi(score, trans, bounds)
        for a, b in itertools.pairwise(bounds.tolist()):
            if a < b:
                own = tags[a:b]
                value = score[np.arange(a, b), own].sum() + sum(trans[x, y] for x, y in itertools.pairwise(own.tolist()))
                assert abs(value - _brute_viterbi(score[a:b], trans)[0]) < 1e-9


def test_redaction_leaves_clean_texts_alone(spark):
    rows = [(1, "mail bob@example.com or +1 (415) 555-0100", 7), (2, "clean é text.", 8), (3, None, None), (None, "", 0)]
    got = {r["doc_id"]: r for r in pii.redact_pii(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert got[1]["text"] == "mail [EMAIL] or [PHONE]" and got[1]["n_chars"] == 7
    assert got[2]["text"] == "clean é text." and got[3]["text"] is None and got[None]["text"] == ""


def test_spans_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "bob@example.com", "x"), (1, None, "y"), (1, "", None)], "doc_id long, text string, spans string")
    assert [(r["doc_id"], r["n_email"], r["spans"]) for r in pii.pii_digest(df).collect()] == [(None, 1, "email:0:15"), (1, 0, ""), (1, 0, "")]
    assert secrets.secret_digest(df.where("doc_id = 9")).count() == 0


# Language ---------------------------------------------------------------------


def test_language_is_right_on_held_out_rows(spark, duck):
    folder = "/root/testdata/sf0.01"
    truth = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect())
    rows = QUERIES["op4_language_id"](spark, folder).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows) and len(rows) == len(truth)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert sum(r["rejected"] for r in rows) <= 0.01 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)


def _small_model():
    texts = {"aa": ["the cat sat on the mat and the dog ran"] * 3, "bb": ["der hund lief und die katze schlief öfter"] * 3}
    return language_id.calibrate(language_id.fit(texts), texts)


def test_kneser_ney_probabilities_sum_to_one():
    model = _small_model()
    letters = sorted(set("the cat sat on the mat and the dog ran der hund lief und die katze schlief öfter"))
    for context in ("the", " ca", "zzz", "die", "n d"):
        points = np.array([ord(c) for x in letters for c in context + x], np.uint32)
        places = np.arange(3, len(points), 4)
        total = np.exp(language_id.log_probabilities(points, places, model)).sum(0)
        # What is left of one is what the floor keeps for unseen characters.
        assert (total <= 1 + 1e-9).all() and (total > 0.9).all()


def test_language_of_odd_rows(spark):
    model = _small_model()
    rows = [(1, "the dog", "x"), (2, "die katze", "y"), (3, None, None), (4, "", None), (5, "123 !?", None), (None, "the mat", None), (6, "жщю " * 20, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    assert {i: r["lang_pred"] for i, r in got.items()} | {6: ""} == {1: "aa", 2: "bb", 3: "und", 4: "und", 5: "und", None: "aa", 6: ""}
    assert got[6]["rejected"] and not got[1]["rejected"] and got[5]["rejected"] and got[5]["score"] == 0
    nothing = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language_id.language_id(nothing).first()["lang_pred"] == "und"
    assert language_id.language_id(nothing.where("doc_id = 2")).count() == 0


FOREIGN = [
    "La biblioteca della città apre ogni mattina alle nove e molti studenti arrivano presto per trovare un posto vicino alle finestre",
    "De bibliotheek van de stad gaat elke ochtend om negen uur open en veel studenten komen vroeg om een plaats bij het raam te vinden",
    "Biblioteka miejska otwiera się każdego ranka o dziewiątej i wielu studentów przychodzi wcześnie, aby znaleźć miejsce przy oknie",
    "Городская библиотека открывается каждое утро в девять часов, и многие студенты приходят рано, чтобы найти место у окна",
    "qzv wkjx ptrq hhgb xxvn lqpz rrtw mnbv zxqj kkwp " * 3,
]


@pytest.mark.parametrize("few", [1, 2, 3, 5])
def test_sparse_language_rejects_what_fits_none(spark, few):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 200")
    spanish = docs.where("lang = 'es'").orderBy("doc_id")
    labelled = docs.where("lang <> 'es'").unionByName(spanish.limit(few))
    model = language_id.learn(labelled, "doc_id", "text", "lang")
    assert np.isfinite(model.reject_at).all()
    df = spark.createDataFrame(list(enumerate(FOREIGN)), "doc_id long, text string")
    assert all(r["rejected"] for r in language_id.identify(df, model).collect())
    own = language_id.identify(spanish, model).collect()
    assert np.mean([r["lang_pred"] == "es" and not r["rejected"] for r in own]) >= 0.95


def test_bound_without_usable_calibration_texts():
    model = language_id.fit({"aa": ["the cat sat on the mat"], "bb": ["der hund lief"]})
    for texts in ({"aa": [], "bb": []}, {"aa": ["a cat"], "bb": []}, {"aa": ["zzz qqq xxx www vvv uuu kkk jjj"], "bb": []}):
        found = language_id.calibrate(model, texts).reject_at
        assert (found <= np.log(len(model.grams[0]) + 1)).all()


# Toxicity ---------------------------------------------------------------------


def test_toxicity_separates_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = dict(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").collect())
    rows = [r for r in QUERIES["op2_toxicity"](spark, folder).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    toxic, clean = [r["score"] for r in rows if labels[r["doc_id"]]], [r["score"] for r in rows if not labels[r["doc_id"]]]
    assert sum(s >= toxicity.THRESHOLD for s in toxic) >= 0.8 * len(toxic)
    assert sum(s >= toxicity.THRESHOLD for s in clean) <= 0.01 * len(clean)
    assert all(r["predicted"] == (r["score"] >= toxicity.THRESHOLD) for r in rows)


def test_fitting_reads_whole_texts(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choices(["melon", "linen", "ranero", "sistol", "tuneral", "omareli"], k=n))
    # What is toxic, and what is the language, comes after 9,000 characters.
    rows = [(i, f"{prose(1600)} {'xqzzk kqxzz wjjqx' if i % 2 else prose(3)}", "aa", i % 2) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.learn(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), "doc_id", "text", "toxic")
    found = [r["score"] for r in toxicity.score(docs, model).orderBy("doc_id").collect()]
    assert min(found[1::2]) > toxicity.THRESHOLD > max(found[::2])
    model = language_id.learn(docs, "doc_id", "text", "lang")
    asked = language_id.folded_points(["xqzzk"])[0]
    assert np.isin(language_id.gram_hashes(asked, 4)[5:], model.grams[3]).all()


def test_label_model_sees_through_noise():
    rng = np.random.default_rng(2)
    truth = rng.random(3000) < 0.3
    rates = [(0.8, 0.05), (0.7, 0.1), (0.6, 0.02), (0.5, 0.5)]
    votes = np.stack([np.where(truth, rng.random(3000) < p, rng.random(3000) < q) for p, q in rates], 1)
    votes = np.concatenate([votes, votes[:, 3:4], votes[:, 3:4]], 1)  # one bad voter three times
    labels = np.where(rng.random(3000) < 0.15, ~truth, truth).astype(int)
    found = toxicity.label_model(votes.astype(float), labels) > 0.5
    assert (found == truth).mean() > max((labels == truth).mean(), 0.9)


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, "you stupid idiot clown" if i % 3 == 0 else "a fine day") for i in range(60)] + [(None, None), (70, ""), (70, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(99, 1), (None, 1), (5, None), (6, 7)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 63 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 60)
    assert {r["predicted"] for r in got if r["doc_id"] in (None, 70)} == {0}
    assert {r["score"] for r in toxicity.toxicity(docs, labels.where("doc_id > 900")).collect()} == {0.0}
    assert toxicity.toxicity(docs.where("doc_id > 900"), labels).count() == 0


# Quality rules ----------------------------------------------------------------


def brute_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    inside = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_quality_counts_match_brute_force(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["a", "b", "é\U0001f600", " ", "  ", "\n", "\t", "#", "|", "a b c d e ", "\x1c", "\x0b"]) for _ in range(rng.randrange(0, 80))) for _ in range(300)] + [None, "", "x " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "cast(null as string) as source", "1 as n", "'q' as kept")
    for r in quality_rules.quality_rules(df).collect():
        expected = brute_quality(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
        assert r["base_failed"] == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0]) and r["kept"] == (not r["base_failed"])


def test_bad_hosts_lose_their_documents(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "a b"
    rows = [(i, good if i % 50 else bad, f"h{i % 20}") for i in range(2000)]
    rows += [(5000 + i, bad if i % 10 else good, "spam") for i in range(200)] + [(9000, bad, "once"), (9001, good, None)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[5000 + i]["kept"] for i in range(200)) and got[9001]["kept"]
    assert all(got[i]["kept"] == bool(i % 50) for i in range(2000))
    assert quality_rules.quality_rules(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


# Chat -------------------------------------------------------------------------


def test_renderings_hold_their_masks(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", "é ho"), (1, 2, "cy", None), (1, 3, "ann", "bye"), (2, 0, "system", "alone"), (None, 0, "dee", "x"), (3, 0, None, "who"), (3, 1, "eve", "me"), (3, 1, "eve", "me")]
    segments = chat_format.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r["conv_id"], r["perspective"]): r for r in chat_format.assemble(segments).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "cy"), (None, "dee"), (3, "eve")}
    ann = got[1, "ann"]
    assert ann["rendering"] == (
        "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi < |end|><|end|>\n<|user name=bob|>\né ho<|end|>\n<|user name=cy|>\n<|end|>\n<|assistant|>\nbye<|end|>\n"
    )
    assert [ann["rendering"][m["start"] : m["end"]] for m in ann["masks"]] == ["hi < |end|><|end|>\n", "bye<|end|>\n"]
    assert got[3, "eve"]["rendering"].startswith("<|user|>\nwho<|end|>\n") and len(got[3, "eve"]["masks"]) == 2
    assert chat_format.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_long_dialogues_are_placed_across_blocks(spark):
    n = 3 * chat_format.BLOCK + 17
    df = spark.range(n).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'u', 'a') as role", "repeat('x', cast(id % 11 as int)) as text")
    rows = sorted(chat_format.rotate(df).where("perspective = 'a'").collect(), key=lambda r: r["turn"])
    at = 0
    for r in rows:
        assert r["start"] == at
        at += len(r["segment"])
    assert len(rows) == n and chat_format.assemble(chat_format.rotate(df), max_turns=100).count() == 0


def test_rows_of_one_turn_or_none_are_placed(spark):
    """Very many rows without a turn number, and equal rows, in one dialogue."""
    rows = [(1, None, "ann", f"{i % 97:03d} x{i % 7}") for i in range(600)] + [(1, 4, "bob", "same")] * 50 + [(1, 4, None, "who")] * 3
    rotated = chat_format.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = sorted(rotated.where("perspective = 'bob'").collect(), key=lambda r: r["start"])
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3]))
    at = 0
    for r, (_, turn, speaker, text) in zip(got, order, strict=True):
        assert (r["start"], r["turn"], r["speaker"]) == (at, turn, speaker) and text in r["segment"]
        at += len(r["segment"])

"""A long text is handled in pieces with the results of the whole."""

import random

import numpy as np
import pytest

from tickplane.llm import byte_bpe, crf, language_id, licenses, pii, secrets, textkernel, toxicity
from tickplane.llm.textkernel import joined, word_pieces, words

SIZES = (700, 20_000)


@pytest.fixture(scope="module")
def text():
    rng = random.Random(12)
    lines = [x.replace("{{", "").replace("}}", "") for x in (secrets.TABLE + pii.TABLE).strip().splitlines()]
    lines += [t for t in licenses.TEMPLATES.values()] + ["you stupid fool!! go", "idiote, toi!!", "f**k é", "\n\n", "x" * 3000]
    return " ".join(rng.choice(lines) for _ in range(1500))


def _cut(monkeypatch, module, size):
    monkeypatch.setattr(module, "CHUNK_BYTES", size)
    monkeypatch.setattr(module, "word_pieces", lambda texts: word_pieces(texts, size))


def test_pieces_end_between_words(text):
    for size in (5, *SIZES):
        pieces = list(word_pieces(joined([text.encode()]), size))
        assert b"".join(p.data.tobytes() for _, p in pieces).decode() == text
        assert [w for _, p in pieces for w in p.data.tobytes().split()] == text.encode().split()


@pytest.mark.parametrize("size", [3, 1000])
def test_word_hashes_do_not_depend_on_pieces(text, monkeypatch, size):
    part = joined([text[:30_000].encode(), b"", b"one"])
    whole = words(part).hash
    monkeypatch.setattr(textkernel, "CHUNK_BYTES", size)
    assert (words(part).hash == whole).all()


@pytest.mark.parametrize("module", [pii, secrets])
def test_tagged_spans(text, monkeypatch, module):
    part = joined([text.encode()])
    monkeypatch.setattr(crf, "CHUNK_BYTES", 1 << 40)
    whole = crf.tagged_spans(part, module.model())
    for size in SIZES:
        _cut(monkeypatch, crf, size)
        assert crf.tagged_spans(part, module.model()) == whole and len(whole) > 100


def test_votes(text, monkeypatch):
    part, voters = joined([text.encode()]), toxicity.make_voters([])
    monkeypatch.setattr(toxicity, "CHUNK_BYTES", 1 << 40)
    votes, n = toxicity.count_votes(part, voters)
    for size in SIZES:
        _cut(monkeypatch, toxicity, size)
        again, m = toxicity.count_votes(part, voters)
        assert (again == votes).all() and (m == n).all() and votes.sum() > 20


def test_licences(text, monkeypatch):
    part, templates = joined([text.encode()]), licenses.Templates(licenses.TEMPLATES)
    monkeypatch.setattr(licenses, "CHUNK_BYTES", 1 << 40)
    whole = list(licenses.scan(part, templates))
    for size in SIZES:
        _cut(monkeypatch, licenses, size)
        assert list(licenses.scan(part, templates)) == whole and len(whole) > 50


def test_cross_entropy(text, monkeypatch):
    model = language_id.fit({"a": [text[:4000]], "b": [text[4000:9000]]})
    for sample in (text, "", " ", "ab", "  é "):
        whole, letters = language_id.cross_entropies([sample], model)
        for size in (2, 5000):
            monkeypatch.setattr(language_id, "CHUNK", size)
            entropy, n = language_id.long_cross_entropy(sample, model)
            assert np.allclose(entropy, whole) and n == letters


def test_tokens(text, monkeypatch):
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        codec = byte_bpe.ByteBpe(f.read(), public_tokenizers.PATTERN)
    whole = codec.encode_all(["a b", text, ""])
    monkeypatch.setattr(byte_bpe, "LONG", 100)
    monkeypatch.setattr(byte_bpe, "TAKEN", 1000)
    assert codec.encode_all(["a b", text, ""]) == whole
    assert codec.decode(whole[1]).decode() == text


def test_licence_search_passes_over_no_stretch():
    """What the bound passes over has no alignment that reaches the coverage."""
    rng = random.Random(3)
    words_ = licenses.TEMPLATES["isc"].split(" ")
    templates = licenses.Templates({"isc": licenses.TEMPLATES["isc"]})
    for _ in range(30):
        own = [w for w in words_ if rng.random() > 0.1]
        lead, tail = ([rng.choice(words_) for _ in range(rng.randrange(0, 20))] for _ in range(2))
        found = list(licenses.scan(joined([" ".join(lead + own + tail).encode()]), templates))
        assert len(found) == (len(own) >= 0.8 * len(words_)) or len(own) < 0.85 * len(words_)


def test_interrupted_notice_is_found_and_scattered_words_are_not():
    words_ = licenses.TEMPLATES["mit"].split(" ")
    templates = licenses.Templates(licenses.TEMPLATES)
    other = [f"p{i}" for i in range(90)]
    body = " ".join(words_[:40] + other + words_[40:])
    assert [(n, c, a, b) for _, n, c, a, b in licenses.scan(joined([body.encode()]), templates)] == [("mit", 1.0, 0, len(body) - 1)]
    scattered = " ".join(x for w in words_ for x in [w, *other[:12]])
    assert not list(licenses.scan(joined([scattered.encode()]), templates))


def test_licence_offsets_are_those_of_the_text(spark):
    rows = [(1, "İİİİ Released under the MIT License."), (1, "İİİİ Released under the MIT License."), (None, "RELEASED under the mit license")]
    got = sorted((r["doc_id"] or 0, r["start"], r["end"]) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0, 30), (1, 5, 35), (1, 5, 35)]
    assert licenses.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hostile_megabytes_are_quick():
    rng = random.Random(5)
    pool = [w for t in licenses.TEMPLATES.values() for w in t.split()]
    shuffled = " ".join(rng.choice(pool) for _ in range(150_000))
    assert len(shuffled) > 900_000
    list(licenses.scan(joined([shuffled.encode()]), licenses.Templates(licenses.TEMPLATES)))
    for module in (pii, secrets):
        module.make_scan()(joined([shuffled.encode()]))


def test_repeated_rows_are_fitted_once(spark, monkeypatch):
    """An id or text that very many rows repeat comes to the driver once, and so do rows without an id."""
    rows = [(1, f"you idiot fool {'x' * 40}", "en")] * 3000 + [(i, f"plain words number {i} stand here", "en") for i in range(2, 40)] + [(None, "words without an id stand here", "en")] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (1, 1)] + [(i, 0) for i in range(2, 40)], "doc_id long, toxic int")
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: seen.update(toxic=(len(texts), int(labels.sum()))))
    monkeypatch.setattr(language_id, "fit", lambda texts: seen.update(lang={k: len(v) for k, v in texts.items()}))
    monkeypatch.setattr(language_id, "calibrate", lambda model, held: seen.update(held={k: len(v) for k, v in held.items()}))
    toxicity.learn(docs, labels, "doc_id", "text", "toxic")
    language_id.learn(docs, "doc_id", "text", "lang")
    assert seen["toxic"] == (39, 1) and seen["lang"]["en"] + seen["held"]["en"] == len({t for _, t, _ in rows})


def test_slices_of_a_batch_give_the_same_rows(monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["a b", None, "", "c é d", "e", None, "f g h i j k", " ", "l"])], ["n", "t"])

    def run(batches):
        for b in batches:
            hashes = [words(part).hash.tolist() for part in textkernel.text_chunks(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(hashes[0])] * b.num_rows)], ["n", "words"])

    for size in (1, 2, 4, 100):
        monkeypatch.setattr(textkernel, "BATCH_ROWS", size)
        out = list(textkernel.tidy(run)([batch, batch.slice(3, 2), batch.slice(0, 0)]))
        assert [n for b in out for n in b.column(0).to_pylist()] == [*range(9), 3, 4]
        assert sum(b.column(1)[0].as_py() for b in out) == 13 + 4

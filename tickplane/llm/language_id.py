"""Language identification by interpolated Kneser-Ney character models.

One model per language over letters and single blanks.  The n-grams of all
languages stand together in sorted arrays of 64-bit hashes, one array per order,
with a row of natural-log probabilities for each: column l is what language l's
interpolated model gives, whether that language has the n-gram or not.  So a
character costs one binary search at the longest order, and further ones only
where the n-gram is new.  A new n-gram's probability is its back-off:
the context's weight times the next shorter order's probability.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickplane.llm.textkernel import mix64, text_chunks, tidy

ORDER = 4
#: The models are fitted on at most this many distinct texts of each language,
#: those of the least hashes, and on no more once these have so many characters
#: on average; each text is read whole.  Texts of more than FIT_LONGEST characters
#: teach nothing, which bounds what the driver holds.
FIT_TEXTS, FIT_CHARS, FIT_LONGEST = 400, 2000, 1_000_000
#: Kneser-Ney discount.
DISCOUNT = 0.75
UNKNOWN = "und"
#: At most this share of a language's own texts is rejected, whatever their
#: cross-entropies' distribution: Cantelli's inequality turns it into standard
#: deviations over the mean of texts that were not fitted.  The bound is also at
#: least the slack in nats over that mean.
REJECT_RATE, REJECT_SLACK = 0.015, 1.0
#: Rejection needs this many letters; fewer say too little.
REJECT_LETTERS = 20
#: A language with fewer calibration texts than this takes a pooled bound.
LEAST_HELD = 8
#: How far the bound of such a language may go from the mean of pooled texts to
#: what its model gives texts of others.  A model of a few texts finds its own
#: language less likely than others find theirs, so it is more than half.
SPARSE_SHARE = 2 / 3

#: Bytes of text scored at once: each takes about 150 bytes of working arrays.
CHUNK = 1 << 18

_KEYS = np.random.default_rng(11).integers(0, 1 << 63, ORDER + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = 0x20


@functools.cache
def _folded() -> np.ndarray:
    """For each code point: its lower-case letter, or a blank for what is no letter."""
    points = np.full(0x110000, _BLANK, np.uint32)
    for c in range(0x110000):
        char = chr(c)
        if char.isalpha():
            low = char.lower()
            points[c] = ord(low[0])
    return points


def folded_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' letters, lower-cased, other runs as one blank; and text bounds.

    Every text begins with ORDER - 1 blanks, which are context only, and ends
    with a blank.
    """
    pad = " " * (ORDER - 1)
    points = _folded()[np.frombuffer("".join(f"{pad}{t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    bounds = np.concatenate(([0], np.cumsum([len(t) + ORDER for t in texts]))).astype(np.int64)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != _BLANK) | (points[:-1] != _BLANK)
    for i in range(ORDER - 1):
        keep[bounds[:-1] + i] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    return points[keep], kept[bounds]


def gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that end at each place (places before n - 1 wrap)."""
    if n == 0:
        return np.zeros(len(points), np.uint64)
    wide = points.astype(np.uint64)
    out = np.zeros(len(points), np.uint64)
    for i in range(n):
        out += np.roll(wide, i) * _KEYS[i]
    return mix64(out + np.uint64(n))


@dataclass
class Model:
    languages: list[str]
    #: By order 1..ORDER: sorted n-gram hashes and log probabilities by language.
    grams: list[np.ndarray]
    logs: list[np.ndarray]
    #: By order 1..ORDER - 1: sorted context hashes and log back-off weights.
    contexts: list[np.ndarray]
    backoffs: list[np.ndarray]
    #: What a character that no language has seen gets.
    floor: np.ndarray
    reject_at: np.ndarray | None = None


def _index(table: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(table, asked), len(table) - 1)
    return at, table[at] == asked


def log_probabilities(points: np.ndarray, places: np.ndarray, model: Model) -> np.ndarray:
    """Natural-log probability of the characters at ``places`` in each language."""
    out = np.zeros((len(places), len(model.languages)))
    todo = np.arange(len(places))
    for n in range(ORDER, 0, -1):
        asked = gram_hashes(points, n)[places[todo]]
        at, found = _index(model.grams[n - 1], asked)
        out[todo[found]] += model.logs[n - 1][at[found]]
        todo = todo[~found]
        if not len(todo):
            return out
        if n > 1:
            context = np.roll(gram_hashes(points, n - 1), 1)[places[todo]]
            at, found = _index(model.contexts[n - 2], context)
            out[todo[found]] += model.backoffs[n - 2][at[found]]
    out[todo] += model.floor
    return out


def fit(texts: dict[str, list[str]]) -> Model:
    """Fit interpolated Kneser-Ney models on the texts of each language."""
    languages = sorted(texts)
    streams = []
    for lang in languages:
        points, bounds = folded_points(texts[lang])
        scored = np.ones(len(points), bool)
        for i in range(ORDER - 1):
            scored[bounds[:-1] + i] = False
        streams.append((points, np.flatnonzero(scored)))
    # By order: each distinct n-gram with its context's and suffix's hash, and counts by language.
    grams, context_of, suffix_of, counts = [], [], [], []
    for n in range(1, ORDER + 1):
        found = []
        for points, at in streams:
            own, context = gram_hashes(points, n)[at], np.roll(gram_hashes(points, n - 1), 1)[at]
            suffix = gram_hashes(points, n - 1)[at]
            distinct, first, count = np.unique(own, return_index=True, return_counts=True)
            found.append((distinct, context[first], suffix[first], count))
        every, first = np.unique(np.concatenate([f[0] for f in found]), return_index=True)
        grams.append(every)
        context_of.append(np.concatenate([f[1] for f in found])[first])
        suffix_of.append(np.concatenate([f[2] for f in found])[first])
        table = np.zeros((len(every), len(languages)))
        for l, (distinct, _, _, count) in enumerate(found):
            table[np.searchsorted(every, distinct), l] = count
        counts.append(table)
    # Below the longest order an n-gram counts by how many characters stand before it.
    for n in range(1, ORDER):
        table = np.zeros_like(counts[n - 1])
        np.add.at(table, np.searchsorted(grams[n - 1], suffix_of[n]), counts[n] > 0)
        counts[n - 1] = table
    symbols = len(grams[0]) + 1.0  # those of all languages, and one for the rest
    lower, logs, contexts, backoffs = None, [], [], []
    floor = None
    for n in range(1, ORDER + 1):
        context, inverse = np.unique(context_of[n - 1], return_inverse=True)
        total, kinds = np.zeros((len(context), len(languages))), np.zeros((len(context), len(languages)))
        np.add.at(total, inverse, counts[n - 1])
        np.add.at(kinds, inverse, counts[n - 1] > 0)
        # A context that a language has not seen hands all its mass to the shorter order.
        weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        if n == 1:
            floor = weight[0] / symbols
            below = np.broadcast_to(floor, counts[0].shape)
        else:
            below = lower[np.searchsorted(grams[n - 2], suffix_of[n - 1])]
            contexts.append(context)
            backoffs.append(np.log(weight))
        here = np.maximum(counts[n - 1] - DISCOUNT, 0) / np.maximum(total[inverse], 1)
        lower = here + (weight[inverse] * below if n > 1 else below)
        logs.append(np.log(lower))
    return Model(languages, grams, logs, contexts, backoffs, np.log(floor))


def cross_entropies(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Nats per scored character in each language, and each text's letters."""
    points, bounds = folded_points(texts)
    scored = np.ones(len(points), bool)
    for i in range(ORDER - 1):
        scored[bounds[:-1] + i] = False
    places = np.flatnonzero(scored)
    logs = log_probabilities(points, places, model)
    cuts = np.searchsorted(places, bounds)
    sums = np.concatenate((np.zeros((1, logs.shape[1])), np.cumsum(logs, 0)))
    total = sums[cuts[1:]] - sums[cuts[:-1]]
    letters = np.concatenate(([0], np.cumsum(scored & (points != _BLANK))))
    return -total / np.maximum(np.diff(cuts), 1)[:, None], letters[bounds[1:]] - letters[bounds[:-1]]


def long_cross_entropy(text: str, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """``cross_entropies`` of one text, CHUNK characters at a time: memory doesn't grow with it."""
    total, n, letters = np.zeros(len(model.languages)), 0, 0
    before = np.full(ORDER - 1, _BLANK, np.uint32)
    for at in range(0, len(text) + 1, CHUNK):
        part = text[at : at + CHUNK] + (" " if at + CHUNK > len(text) else "")
        points = np.concatenate((before[-1:], _folded()[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)]))
        own = points[1:][(points[1:] != _BLANK) | (points[:-1] != _BLANK)]
        points = np.concatenate((before, own))
        total += log_probabilities(points, np.arange(ORDER - 1, len(points)), model).sum(0)
        n, letters, before = n + len(own), letters + int((own != _BLANK).sum()), points[len(own) :]
    return -total[None] / max(n, 1), np.array([letters])


def calibrate(model: Model, texts: dict[str, list[str]]) -> Model:
    """Set each language's rejection bound from texts that are not fitted.

    A language with fewer than LEAST_HELD usable texts takes the bound of all
    texts of the languages that have enough (of all there are, if none has), or
    what lies SPARSE_SHARE of the way from their mean to the mean that its own
    model gives these texts, if that is more.  The bound is never over the entropy of evenly drawn symbols,
    as such a model is nearly even and would catch what fits no language.
    """
    none = np.zeros((0, len(model.languages)))
    held = []
    for lang in model.languages:
        entropy, letters = cross_entropies(texts[lang], model) if texts.get(lang) else (none, np.zeros(0))
        held.append(entropy[letters >= REJECT_LETTERS])
    even = np.log(len(model.grams[0]) + 1.0)
    deviations = np.sqrt(1 / REJECT_RATE - 1)
    bound_of = lambda own: own.mean() + max(deviations * own.std(), REJECT_SLACK)
    enough = [l for l in range(len(held)) if len(held[l]) >= LEAST_HELD] or [l for l in range(len(held)) if len(held[l])]
    pool = np.concatenate([held[l][:, l] for l in enough] or [np.zeros(0)])
    bound = []
    for l, own in enumerate(held):
        if len(own) >= LEAST_HELD:
            bound.append(bound_of(own[:, l]))
            continue
        others = np.concatenate([held[m][:, l] for m in enough if m != l] or [np.zeros(0)])
        between = pool.mean() + SPARSE_SHARE * (others.mean() - pool.mean()) if len(others) else 0.0
        bound.append(min(max(bound_of(pool), between), even) if len(pool) else even)
    model.reject_at = np.array(bound)
    return model


def learn(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> Model | None:
    """Fit on a bounded sample of labelled rows; None if there is none.

    The sample is FIT_TEXTS distinct texts of each language, those of the least
    hashes of the text, found with one pre-aggregated pass; so rows without an
    id are drawn like others, and any number of copies of a text is one.  A
    quarter of the sample sets the bounds, and languages with too few of these
    share a pooled one.
    """
    known = labelled.where(F.col(lang_col).isNotNull() & (F.char_length(text_col) <= FIT_LONGEST) & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t"))
    # Distinct texts, so that copies don't thin the sample; characters with copies, which only makes it smaller.
    sizes = {r[0]: (max(r[1], 1), r[2]) for r in known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("t")), F.sum(F.char_length("t"))).collect()}
    if not sizes:
        return None
    # Texts are thinned by their hash first, so that no task gathers a language's rows.
    shares = {lang: min(1.0, 1.3 * FIT_TEXTS / n, max(1.3 * FIT_TEXTS * FIT_CHARS / chars, 8 / n)) for lang, (n, chars) in sizes.items()}
    share = F.map_from_arrays(F.lit(list(shares)), F.lit([float(x) for x in shares.values()]))[F.col("lang")]
    thinned = known.where(F.pmod(F.xxhash64("t", F.lit(1)), F.lit(1 << 20)) < share * (1 << 20))
    rows = thinned.withColumn("h", F.xxhash64("t")).distinct().collect()
    texts: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r["h"], r["t"])):
        texts.setdefault(row["lang"], []).append(row["t"])
    for lang, own in texts.items():
        before = np.cumsum([0, *map(len, own)])[:-1]
        texts[lang] = [t for t, n in zip(own[:FIT_TEXTS], before, strict=False) if n < FIT_TEXTS * FIT_CHARS]
    held = {lang: own[: len(own) // 4] for lang, own in texts.items()}
    return calibrate(fit({lang: own[len(own) // 4 :] for lang, own in texts.items()}), held)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """The columns ``keep``, ``lang_pred``, ``score`` and ``rejected`` (by ``names``) of each row.

    ``lang_pred`` is the language of the lowest cross-entropy per character
    (the first by name among equals), or ``und`` where the text is null or has no
    letter, or nothing could be learned; ``score`` is the softmax of the negative
    cross-entropies, tempered by the text's length, and 0 for ``und``.
    ``rejected`` says that the text is ``und`` or that even the best model finds
    it too unlike its language.  Whole texts are scored.
    """
    made = [T.StructField(name, kind) for name, kind in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)]
    schema = T.StructType([*(docs.schema[c] for c in keep), *made])
    # A text that is kept anyway is not sent twice.
    place = keep.index(text_col) if text_col in keep else len(keep)
    source = docs.select(*keep) if text_col in keep else docs.select(*keep, docs[text_col].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang: list[str] = [UNKNOWN] * batch.num_rows
            score, rejected = np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            for part in text_chunks(batch.column(place), CHUNK) if model else ():
                texts = [part.bytes_of(i).decode() for i in range(len(part))]
                entropy, letters = long_cross_entropy(texts[0], model) if len(texts[0]) > CHUNK else cross_entropies(texts, model)
                best = entropy.argmin(1)
                low = entropy[np.arange(len(best)), best]
                tempered = np.exp((low[:, None] - entropy) * np.minimum(letters, 50)[:, None]).sum(1)
                for i in np.flatnonzero(letters > 0).tolist():
                    row = part.first + i
                    lang[row] = model.languages[best[i]]
                    score[row] = 1 / tempered[i]
                    rejected[row] = letters[i] >= REJECT_LETTERS and low[i] > model.reject_at[best[i]]
            columns = [*batch.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return source.mapInArrow(tidy(run), schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of its id as text, mod 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn on the rows that are not held out, predict all.

    Returns (id_col, held_out, lang_pred, score, rejected).  Rows without an id
    are not held out.  Null languages teach nothing; an empty table gives an
    empty result; repeated rows repeat their prediction.
    """
    model = learn(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    found = identify(docs, model, text_col, (id_col,))
    return found.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "rejected")

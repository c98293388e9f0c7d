"""Toxicity by weak supervision.

Voters are lexicon words, word beginnings mined from labelled rows, and
patterns.  A generative label model estimates each voter's accuracy and the
voters' correlations: given the class, voters form a tree of the strongest
conditional dependences, whose tables are fitted by expectation maximisation
until they settle; the given label is one more voter, of no special trust.  A linear classifier is then trained on the
model's posterior labels, and scores whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickplane.llm.textkernel import CHUNK_BYTES, Texts, byte_sums, hashes_between, joined, lowered, text_chunks, tidy, word_pieces, word_spans

#: The models are fitted on at most so many labelled rows of each class, those
#: of the least hashed ids, and on no more once these have so many characters on
#: average; each text is read whole.  Texts of more than FIT_LONGEST characters
#: teach nothing, which bounds what the driver holds.
FIT_TOXIC, FIT_CLEAN, FIT_CHARS, FIT_LONGEST = 1500, 3000, 8000, 1_000_000
#: Bytes of text that fitting looks at together.
FIT_CHUNK = 1 << 20
#: A score from here on is predicted as toxic.
THRESHOLD = 0.7
#: Rounds in which the label model chooses its tree anew.
TREE_ROUNDS = 20
#: Mined word beginnings: their lengths in bytes (0: the whole word) and how many at most.
LENGTHS = (4, 5, 6, 7, 8, 9, 0)
MINED = 96

#: Insults of four languages, lower case.
LEXICON = (
    "idiot", "idiots", "stupid", "moron", "morons", "dumb", "imbecile", "fool", "loser", "losers", "clown", "trash", "garbage", "scum", "filth", "vermin",
    "pathetic", "worthless", "useless", "disgusting", "vile", "revolting", "pig", "rat", "creep", "jerk", "freak", "coward", "liar", "bastard", "bitch",
    "crap", "shit", "damn", "fuck", "fucking", "asshole", "whore", "slut", "hate", "kill", "die",
    "idiote", "stupide", "imbécile", "crétin", "connard", "salope", "ordure", "minable", "dégueulasse", "abruti",
    "dumm", "dummkopf", "trottel", "abschaum", "widerlich", "wertlos", "arschloch", "scheiße", "verlierer",
    "idiota", "estúpido", "imbécil", "basura", "escoria", "patético", "inútil", "asqueroso", "payaso", "mierda",
)
#: Words that address someone.
ADDRESS = ("you", "your", "you're", "u", "du", "dein", "ihr", "tu", "toi", "vous", "eres", "usted")
PATTERNS = ("two hits", "three kinds", "addressed", "shouted", "masked")

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _hash_of(words: tuple[str, ...]) -> np.ndarray:
    texts = joined([w.encode() for w in words])
    return hashes_between(byte_sums(texts), texts.offsets[:-1], texts.offsets[1:])


@dataclass
class Voters:
    """Sorted hashes by prefix length (0: whole word) with the voter of each."""

    tables: dict[int, tuple[np.ndarray, np.ndarray]]
    n_words: int
    n_lexicon: int

    @property
    def size(self) -> int:
        return self.n_words + len(PATTERNS)


def make_voters(mined: list[tuple[int, int]]) -> Voters:
    """Voters for the lexicon and for mined (length, hash) pairs."""
    by_length: dict[int, dict[int, int]] = {0: {int(h): i for i, h in enumerate(_hash_of(LEXICON))}}
    number = len(LEXICON)
    for length, value in mined:
        if value not in by_length.setdefault(length, {}):
            by_length[length][value] = number
            number += 1
    tables = {}
    for length, entries in by_length.items():
        keys = np.array(sorted(entries), np.uint64)
        tables[length] = (keys, np.array([entries[int(k)] for k in keys]))
    return Voters(tables, number, len(LEXICON))


def _cores(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words without ASCII punctuation at their ends (those that are more), and the row of each."""
    start, end, bounds = word_spans(texts)
    size = len(texts.data)
    if not len(start):
        return start, end, start
    place, inner = np.arange(size), _ALNUM[texts.data]
    following = np.minimum.accumulate(np.where(inner, place, size)[::-1])[::-1]
    preceding = np.maximum.accumulate(np.where(inner, place, -1))
    a, b = following[start], preceding[end - 1] + 1
    keep = (a < end) & (b > a)
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    return a[keep], b[keep], row[keep]


def _hits(texts: Texts, voters: Voters, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hits of each row and voter, the patterns' still as counts, its words, and whether the last two words address someone.

    ``before`` says that of the two words before the first row.
    """
    low = lowered(texts)
    start, end, row = _cores(low)
    n, first = len(texts), voters.n_words
    votes = np.zeros((n, voters.size), np.float32)
    votes[:, first + 3] = [texts.bytes_of(i).count(b"!!") for i in range(n)]
    words = np.bincount(row, minlength=n)
    if not len(start):
        return votes, words, before
    sums, length = byte_sums(low), end - start
    lexical = np.zeros(len(start), bool)
    for k, (keys, number) in voters.tables.items():
        stop = end if k == 0 else np.minimum(start + k, end)
        asked = hashes_between(sums, start, stop)
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        hit = np.flatnonzero((keys[at] == asked) & (length >= k))
        np.add.at(votes, (row[hit], number[at[hit]]), 1)
        if k == 0:
            lexical[hit[number[at[hit]] < voters.n_lexicon]] = True
    votes[:, first] = np.bincount(row[lexical], minlength=n)
    address = np.concatenate((before, np.isin(hashes_between(sums, start, end), _hash_of(ADDRESS))))
    owner = np.concatenate(([0, 0], row))
    near = np.zeros(len(start), bool)
    for by in (1, 2):
        near |= lexical & address[2 - by : -by] & (owner[2 - by : -by] == row)
    votes[:, first + 2] = np.bincount(row[near], minlength=n)
    stars = np.concatenate(([0], np.cumsum(low.data == 42)))
    votes[:, first + 4] = np.bincount(row[stars[end] > stars[start]], minlength=n)
    return votes, words, address[-2:]


def count_votes(texts: Texts, voters: Voters) -> tuple[np.ndarray, np.ndarray]:
    """For each row the hits of each voter, and its number of words.

    A long text is counted piece by piece.
    """
    before = np.zeros(2, bool)
    if len(texts) == 1 and len(texts.data) > CHUNK_BYTES:
        votes, words = np.zeros((1, voters.size), np.float32), np.zeros(1, np.int64)
        for _, piece in word_pieces(texts):
            more, counted, before = _hits(piece, voters, before)
            votes, words = votes + more, words + counted
    else:
        votes, words, _ = _hits(texts, voters, before)
    first = voters.n_words
    votes[:, first] = votes[:, first] >= 2
    votes[:, first + 1] = (votes[:, : voters.n_lexicon] > 0).sum(1) >= 3
    votes[:, first + 3] = (votes[:, first + 3] * 10 > words) & (words > 0)
    return votes, words


def _parts(texts: list[str]) -> Iterator[tuple[int, Texts]]:
    """(number of the first, texts) of FIT_CHUNK bytes or one text."""
    part, first, size = [], 0, 0
    for i, text in enumerate(texts):
        raw = text.encode()
        if part and size + len(raw) > FIT_CHUNK:
            yield first, joined(part)
            part, first, size = [], i, 0
        part.append(raw)
        size += len(raw)
    if part:
        yield first, joined(part)


def mine(texts: list[str], labels: np.ndarray) -> list[tuple[int, int]]:
    """Word beginnings that labelled toxic rows have and clean ones lack."""
    if labels.min() == labels.max():
        return []
    # By length: each row's distinct beginnings.
    pairs: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {k: [] for k in LENGTHS}
    for first_row, low in _parts([t.lower() for t in texts]):
        start, end, row = _cores(low)
        sums = byte_sums(low)
        for k in LENGTHS:
            long_enough = np.flatnonzero(end - start >= max(k, 4))
            keys = hashes_between(sums, start[long_enough], end[long_enough] if k == 0 else start[long_enough] + k)
            order = np.lexsort((row[long_enough], keys))
            keys, owner = keys[order], row[long_enough][order]
            fresh = np.ones(len(keys), bool)
            fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
            pairs[k].append((keys[fresh], owner[fresh] + first_row))
    found = []
    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    for k in LENGTHS:
        keys, owner = (np.concatenate(x) for x in zip(*pairs.pop(k), strict=True))
        if not len(keys):
            continue
        order = np.lexsort((owner, keys))
        keys, owner = keys[order], owner[order]
        distinct, first, count = np.unique(keys, return_index=True, return_counts=True)
        toxic = np.add.reduceat(labels[owner] == 1, first)
        clean = count - toxic
        odds = np.log((toxic + 0.5) / (n1 + 1)) - np.log((clean + 0.5) / (n0 + 1))
        good = np.flatnonzero((toxic >= 3) & (odds > 1.5))
        same = lambda i: hashlib.blake2b(owner[first[i] : first[i] + count[i]].tobytes(), digest_size=16).digest()  # noqa: E731, B023
        found += [(odds[i] * np.sqrt(toxic[i]), k, int(distinct[i]), same(i)) for i in good]
    # The best first; one that fires on the same rows as a better one says nothing new.
    chosen, seen = [], set()
    for _, k, key, rows in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
        if rows not in seen:
            seen.add(rows)
            chosen.append((k, key))
            if len(chosen) == MINED:
                break
    return chosen


def _tree(votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Each voter's parent in the maximum spanning tree of conditional mutual information (-1: root)."""
    j = votes.shape[1]
    info = np.zeros((j, j))
    for w in (weight, 1 - weight):
        total = w.sum() + 2
        both = (votes * w[:, None]).T @ votes + 0.5
        one = np.diag(both) + 0.5
        cells = {(1, 1): both, (1, 0): one[:, None] - both + 0.5, (0, 1): one[None, :] - both + 0.5}
        cells[0, 0] = total - cells[1, 1] - cells[1, 0] - cells[0, 1]
        marginal = {1: one / total, 0: 1 - one / total}
        for (x, y), cell in cells.items():
            p = np.maximum(cell / total, 1e-9)
            info += w.mean() * p * np.log(p / np.maximum(marginal[x][:, None] * marginal[y][None, :], 1e-12))
    parent, best, source = np.full(j, -1), info[0].copy(), np.zeros(j, int)
    inside = np.zeros(j, bool)
    inside[0] = True
    for _ in range(j - 1):
        i = int(np.argmax(np.where(inside, -np.inf, best)))
        parent[i], inside[i] = source[i], True
        better = info[i] > best
        best, source = np.where(better, info[i], best), np.where(better, i, source)
    return parent


def _voters_only(fires: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """P(toxic) by independent voters, whose rates are counted against the given labels."""
    logs = np.zeros((len(fires), 2))
    for y in (0, 1):
        own = labels == y
        p = (fires[own].sum(0) + 1) / (own.sum() + 2)
        logs[:, y] = np.log((own.sum() + 1) / (len(labels) + 2)) + fires @ np.log(p) + (1 - fires) @ np.log(1 - p)
    return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))


def label_model(votes: np.ndarray, labels: np.ndarray, tolerance: float = 1e-4, max_rounds: int = 1000) -> np.ndarray:
    """Posterior P(toxic) of each row from binary votes and the given label.

    Expectation maximisation starts from what the voters say.  The given label
    is one more voter: its two error rates are estimated like all others, so it
    is believed as far as the voters bear it out.  The tree follows the
    posteriors in the first rounds and then stays, so that the rounds settle.
    """
    fires = np.concatenate([(labels == 1)[:, None], votes > 0], 1).astype(float)
    weight, parent = _voters_only(fires[:, 1:], labels), None
    for turn in range(max_rounds):
        parent = _tree(fires, weight) if turn < TREE_ROUNDS else parent
        logs = np.zeros((len(fires), 2))
        up = np.where(parent >= 0, fires[:, np.maximum(parent, 0)], 0.0)
        for y, w in ((0, 1 - weight), (1, weight)):
            logs[:, y] = np.log(w.mean() + 1e-9)
            for v in (0, 1):
                group = w[:, None] * (up == v)
                p = (np.einsum("ij,ij->j", group, fires) + 0.2) / (group.sum(0) + 2.0)
                logs[:, y] += ((up == v) * (fires * np.log(p) + (1 - fires) * np.log(1 - p))).sum(1)
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
        settled = np.abs(new - weight).max() < tolerance
        weight = new
        if settled:
            return weight
    raise RuntimeError("the label model did not settle")


@dataclass
class Model:
    voters: Voters
    weights: np.ndarray
    bias: float


def features(votes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For each voter whether it fires and how often per word, to a bound."""
    density = np.minimum(50 * votes / np.maximum(words, 1)[:, None], 2)
    return np.concatenate([(votes > 0).astype(np.float64), density, np.log1p(votes).clip(0, 2)], 1)


def train_linear(x: np.ndarray, target: np.ndarray, l2: float = 0.02, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on probabilities, by full-batch gradient steps."""
    w, b = np.zeros(x.shape[1]), 0.0
    mean, square = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, rounds + 1):
        error = target - 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        grad = np.append(x.T @ error - l2 * w, error.sum())
        mean += 0.1 * (grad - mean)
        square += 0.01 * (grad * grad - square)
        move = 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w += move[:-1]
        b += move[-1]
    return w, b


def fit(texts: list[str], labels: np.ndarray) -> Model:
    voters = make_voters(mine(texts, labels))
    votes, words = (np.concatenate(x) for x in zip(*(count_votes(part, voters) for _, part in _parts(texts)), strict=True))
    posterior = label_model(votes, labels)
    x = features(votes, words)
    w, b = train_linear(x, posterior)
    return Model(voters, w, b)


def scores(texts: Texts, model: Model) -> np.ndarray:
    votes, words = count_votes(texts, model.voters)
    return 1 / (1 + np.exp(-np.clip(features(votes, words) @ model.weights + model.bias, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Model | None:
    """Fit on a bounded sample of labelled rows; None if there is none."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).alias("__label")).distinct()
    sizes = {r[0]: r[1] for r in known.groupBy("__label").count().collect()}
    if not sizes:
        return None
    share = F.when(F.col("__label") == 1, F.lit(min(1.0, 1.2 * FIT_TOXIC / sizes.get(1, 1)))).otherwise(F.lit(min(1.0, 1.2 * FIT_CLEAN / sizes.get(0, 1))))
    chosen = known.where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(2)), F.lit(1 << 20)) < share * (1 << 20))
    # At most some thousand ids by the line above, whatever the tables' sizes; a
    # repeated id is one row, its shortest text, before anything comes to the driver.
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(text_col, F.lit("")).alias("t"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    met = texts.withColumn("n", F.char_length("t")).where(F.col("n") <= FIT_LONGEST).join(F.broadcast(chosen), F.col("__id") == chosen[id_col])
    # Lengths first: they say up to which hash whole texts fit the bound.
    upto, sizes_of = F.lit(False), met.groupBy("__label", "h").agg(F.min("n").alias("n")).collect()
    for label, most in ((0, FIT_CLEAN), (1, FIT_TOXIC)):
        own = sorted((r["h"], r["n"]) for r in sizes_of if r["__label"] == label)[:most]
        before = np.cumsum([0, *(n for _, n in own)])[:-1]
        fitting = [h for (h, _), n in zip(own, before, strict=True) if n < most * FIT_CHARS]
        if fitting:
            upto = upto | ((F.col("__label") == label) & (F.col("h") <= fitting[-1]))
    rows = met.where(upto).groupBy("__label", "h").agg(F.min(F.struct("n", "t"))["t"].alias("t")).collect()
    kept: list[tuple[int, str]] = []
    for label, most in ((0, FIT_CLEAN), (1, FIT_TOXIC)):
        kept += [(label, r["t"]) for r in sorted((r for r in rows if r["__label"] == label), key=lambda r: (r["h"], r["t"]))[:most]]
    return fit([t for _, t in kept], np.array([label for label, _ in kept])) if kept else None


def score(docs: DataFrame, model: Model | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``score`` of each row, over whole texts.

    Null and empty texts score as texts without words.  Without a model every
    score is 0.
    """
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [scores(part, model) if model else np.zeros(len(part)) for part in text_chunks(batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.concatenate(parts) if parts else np.zeros(0))], schema.names)

    return docs.select(*keep, docs[text_col].alias("__text")).mapInArrow(tidy(run), schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of its id as text, mod 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Learn on the labelled rows that are not held out, score all.

    Returns (id_col, held_out, score, predicted), a row for each row of ``docs``.
    Labels other than 0 and 1 and labels without a text teach nothing; without
    any label every score is 0.  Rows without an id are scored and not held out;
    repeated rows repeat their score; an empty table gives an empty result.
    """
    model = learn(docs, labels.where(~held_out(id_col)), id_col, text_col, label_col)
    found = score(docs, model, text_col, (id_col,))
    return found.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

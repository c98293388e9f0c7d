"""Linear-chain conditional random fields over word shapes.

Tags are outside, begin and inside.  A token's emission is a sum of table rows,
one for each template; templates see the token's shape, its neighbours and,
where wanted, its file.  Training is exact maximum likelihood with an L2 prior
on a small table of marked lines.  Decoding is Viterbi in numpy over whole
pieces of text: a token whose outside score beats the others by more than any
pair of transitions could make up for is outside in every best path, so the
chain is cut there and only what lies between the cuts is searched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tickplane.llm.textkernel import CHUNK_BYTES, Texts, span_hashes, word_pieces, word_spans

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
TAGS = 3
MARKS = ("{{", "}}")

# Byte classes: other punctuation, lower, upper, digit, at, dot, hyphen, assignment, bracket or plus, non-ASCII.
_CLASS = np.zeros(256, np.int8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 9
_CLASS[ord("@")], _CLASS[ord(".")], _CLASS[ord("-")] = 4, 5, 6
_CLASS[[ord(c) for c in "=:"]], _CLASS[[ord(c) for c in "()+_/"]] = 7, 8
_ALNUM = np.isin(_CLASS, (1, 2, 3, 9))
_LENGTHS = np.array([2, 5, 9, 15, 23, 39])
_DIGITS = np.array([1, 3, 6, 9, 10, 16])


@dataclass
class Tokens:
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    #: The token without punctuation at its ends; empty where it has nothing else.
    core_start: np.ndarray
    core_end: np.ndarray
    features: np.ndarray
    #: Tokens with a digit, and with an assignment sign.
    digits: int
    signs: int


@dataclass
class Model:
    keywords: tuple[str, ...]
    file_features: bool
    emit: list[np.ndarray]
    trans: np.ndarray


def _keyword_table(keywords: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    raw = [w.encode() for w in keywords]
    cuts = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    texts = Texts(np.frombuffer(b"".join(raw), np.uint8), cuts, 0)
    hashes = span_hashes(texts, cuts[:-1], cuts[1:])
    order = np.argsort(hashes)
    return hashes[order], order + 1


def template_sizes(keywords: tuple[str, ...], file_features: bool) -> list[int]:
    n = len(keywords) + 1
    return [7 * 4 * 4, 3 * 4 * 4, n, n, n, 28 + 1, 28 + 1, 100, 7 * 3, *([12] if file_features else [])]


def tokenise(texts: Texts, keywords: tuple[str, ...], file_features: bool, of_file: int | None = None) -> Tokens:
    """Tokens of a piece with their template values.

    ``of_file`` is the file's template value where the piece isn't the whole file.
    """
    start, end, bounds = word_spans(texts)
    n, size = len(start), len(texts.data)
    kinds = _CLASS[texts.data]
    sums = np.zeros(size + 1, np.int32)

    def count(*classes: int) -> np.ndarray:
        hit = kinds == classes[0]
        for c in classes[1:]:
            hit |= kinds == c
        np.cumsum(hit, out=sums[1:])
        return sums[end] - sums[start]

    length = end - start
    digit, upper, lower = count(3), count(2), count(1)
    at, dot, hyphen, assign, bracket = count(4), count(5), count(6), count(7), count(8)
    place = np.arange(size)
    alnum = _ALNUM[texts.data]
    following = np.minimum.accumulate(np.where(alnum, place, size)[::-1])[::-1] if size else place
    preceding = np.maximum.accumulate(np.where(alnum, place, -1)) if size else place
    core_start = np.minimum(following[start], end) if n else start
    core_end = np.maximum(preceding[end - 1] + 1, core_start) if n else end
    hashes, numbers = _keyword_table(keywords)
    core = span_hashes(texts, core_start, core_end)
    found = np.minimum(np.searchsorted(hashes, core), len(hashes) - 1)
    keyword = np.where((hashes[found] == core) & (core_end > core_start), numbers[found], 0)

    span = np.searchsorted(_LENGTHS, length)
    ratio = np.where(digit == 0, 0, np.where(digit == length, 3, np.where(2 * digit >= length, 2, 1)))
    coarse = span * 4 + ratio
    first_of_row = np.zeros(n, bool)
    heads = bounds[:-1][np.diff(bounds) > 0]
    first_of_row[heads] = True
    last_of_row = np.zeros(n, bool)
    last_of_row[bounds[1:][np.diff(bounds) > 0] - 1] = True

    def before(x: np.ndarray, edge: int, by: int = 1) -> np.ndarray:
        out = np.full(n, edge, np.int64)
        out[by:] = x[: n - by] if n > by else x[:0]
        out[first_of_row] = edge
        if by == 2 and n > 1:
            out[1:][first_of_row[:-1]] = edge
        return out

    def after(x: np.ndarray, edge: int) -> np.ndarray:
        out = np.full(n, edge, np.int64)
        out[:-1] = x[1:]
        out[last_of_row] = edge
        return out

    columns = [
        (span * 4 + ratio) * 4 + (upper > 0) * 2 + (lower > 0),
        np.minimum(at, 2) * 16 + np.minimum(dot, 3) * 4 + np.minimum(hyphen, 3),
        keyword,
        before(keyword, 0),
        before(keyword, 0, 2),
        before(coarse, 28),
        after(coarse, 28),
        (kinds[start].astype(np.int64) * 10 + kinds[end - 1]) if n else start,
        np.searchsorted(_DIGITS, digit, "right") * 3 + np.where(assign > 0, 2, np.where(bracket > 0, 1, 0)),
    ]
    if file_features:
        rows = np.diff(bounds)
        per_row = lambda x: np.add.reduceat(np.append(x, 0), np.minimum(bounds[:-1], n))[: len(rows)] * (rows > 0)
        values = file_value(per_row(digit > 0), per_row(assign > 0), rows) if of_file is None else np.full(len(rows), of_file)
        columns.append(np.repeat(values, rows))
    return Tokens(start, end, bounds, core_start, core_end, np.stack(columns, 1) if n else np.zeros((0, len(columns)), np.int64), int((digit > 0).sum()), int((assign > 0).sum()))


def file_value(with_digit, with_sign, tokens) -> np.ndarray:
    """Template value of a file: its share of tokens with digits and with assignment signs."""
    share = lambda x: 100 * np.asarray(x) / np.maximum(tokens, 1)
    return np.searchsorted([1, 5, 20], share(with_digit), "right") * 3 + np.searchsorted([1, 5], share(with_sign), "right")


def emissions(features: np.ndarray, emit: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(features), TAGS))
    for i, table in enumerate(emit):
        out += table[features[:, i]]
    return out


def _marked(line: str, keywords: tuple[str, ...], file_features: bool) -> tuple[np.ndarray, np.ndarray]:
    tags, plain, open_, fresh = [], [], False, False
    for word in line.split():
        if word.startswith(MARKS[0]):
            open_, fresh, word = True, True, word[2:]
        closing = MARKS[1] in word
        plain.append(word.replace(MARKS[1], ""))
        tags.append(OUTSIDE if not open_ else BEGIN if fresh else INSIDE)
        fresh = False
        open_ = open_ and not closing
    raw = " ".join(plain).encode()
    texts = Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 0)
    return tokenise(texts, keywords, file_features).features, np.array(tags)


def train(table: list[str], keywords: tuple[str, ...], file_features: bool = False, rounds: int = 400, l2_emit: float = 0.02, l2_trans: float = 0.5) -> Model:
    """Fit by full-batch gradient steps on the exact log likelihood.

    ``table`` holds lines whose spans stand between ``{{`` and ``}}``.
    """
    data = [_marked(line, keywords, file_features) for line in table if line.strip()]
    sizes = template_sizes(keywords, file_features)
    n, width = len(data), max(len(tags) for _, tags in data)
    feats = np.zeros((n, width, len(sizes)), np.int64)
    gold, mask = np.zeros((n, width), np.int64), np.zeros((n, width), bool)
    for i, (f, tags) in enumerate(data):
        feats[i, : len(tags)], gold[i, : len(tags)], mask[i, : len(tags)] = f, tags, True
    emit = [np.zeros((s, TAGS)) for s in sizes]
    trans = np.zeros((TAGS, TAGS))
    params = [*emit, trans]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    lse = lambda x, axis: np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis)) + x.max(axis)
    onehot = np.eye(TAGS)[gold] * mask[..., None]
    pair_mask = mask[:, 1:, None, None]
    gold_pairs = (onehot[:, :-1, :, None] * onehot[:, 1:, None, :]).sum((0, 1))
    for step in range(1, rounds + 1):
        score = sum(t[feats[:, :, i]] for i, t in enumerate(emit)) * mask[..., None]
        alpha, beta = np.zeros((n, width, TAGS)), np.zeros((n, width, TAGS))
        alpha[:, 0] = score[:, 0]
        for j in range(1, width):
            moved = lse(alpha[:, j - 1, :, None] + trans[None], 1) + score[:, j]
            alpha[:, j] = np.where(mask[:, j, None], moved, alpha[:, j - 1])
        for j in range(width - 2, -1, -1):
            moved = lse(trans[None] + (score[:, j + 1] + beta[:, j + 1])[:, None, :], 2)
            beta[:, j] = np.where(mask[:, j + 1, None], moved, 0)
        total = lse(alpha[:, -1], 1)
        node = np.exp(alpha + beta - total[:, None, None]) * mask[..., None]
        edge = np.exp(alpha[:, :-1, :, None] + trans + (score + beta)[:, 1:, None, :] - total[:, None, None, None]) * pair_mask
        grads = []
        for i, table_i in enumerate(emit):
            g = np.zeros_like(table_i)
            np.add.at(g, feats[:, :, i], onehot - node)
            grads.append(g - l2_emit * table_i)
        grads.append(gold_pairs - edge.sum((0, 1)) - l2_trans * trans)
        for p, g, m, v in zip(params, grads, mean, square, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(keywords, file_features, emit, trans)


def slack(trans: np.ndarray) -> float:
    """The most that two transitions can favour a tag over outside, whatever the neighbours."""
    via = trans[:, :, None] + trans[None, :, :]  # before, tag, after
    through = (via - via[:, OUTSIDE : OUTSIDE + 1, :]).max()
    return float(max(through, (trans - trans[:, OUTSIDE : OUTSIDE + 1]).max(), (trans - trans[OUTSIDE : OUTSIDE + 1]).max(), 0.0))


def viterbi(score: np.ndarray, trans: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Best tags of many chains; chain i is ``score[bounds[i]:bounds[i + 1]]``."""
    tags = np.zeros(len(score), np.int8)
    margin = score[:, OUTSIDE] - np.maximum(score[:, BEGIN], score[:, INSIDE])
    open_ = margin <= slack(trans)
    if not open_.any():
        return tags
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(open_)
    head = np.ones(len(at), bool)
    head[1:] = (np.diff(at) > 1) | (row[at[1:]] != row[at[:-1]])
    starts = at[head]
    lengths = np.diff(np.append(np.flatnonzero(head), len(at)))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    left = (starts > 0) & ~np.isin(starts, bounds[:-1])  # an outside token of the same chain stands before
    ends = starts + lengths
    right = (ends < len(score)) & ~np.isin(ends, bounds[1:-1])
    best = score[starts] + np.where(left[:, None], trans[OUTSIDE], 0)
    back: list[np.ndarray] = []
    final = np.empty((len(starts), TAGS))
    for step in range(1, int(lengths[0]) + 1):
        alive = int(np.searchsorted(-lengths, -step, "right"))  # chains of step tokens or more come first
        longer = int(np.searchsorted(-lengths, -(step + 1), "right"))
        final[longer:alive] = best[longer:alive]
        if longer == 0:
            break
        through = best[:longer, :, None] + trans[None]
        back.append(through.argmax(1).astype(np.int8))
        best = through.max(1) + score[starts[:longer] + step]
    final += np.where(right[:, None], trans[:, OUTSIDE], 0)
    tag = final.argmax(1).astype(np.int8)
    for step in range(int(lengths[0]) - 1, -1, -1):
        alive = int(np.searchsorted(-lengths, -(step + 1), "right"))
        tags[starts[:alive] + step] = tag[:alive]
        if step:
            tag[:alive] = back[step - 1][np.arange(alive), tag[:alive]]
    return tags


def _tagged(tags: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans of tagged tokens, given by row, byte range and place; outer punctuation is left off."""
    if not len(tags):
        return []
    head = np.ones(len(tags), bool)
    head[1:] = (np.diff(place) > 1) | (tags[1:] == BEGIN) | (row[1:] != row[:-1])
    first = np.flatnonzero(head)
    last = np.append(first[1:] - 1, len(tags) - 1)
    return [(int(r), int(a), int(b)) for r, a, b in zip(row[first], start[first], end[last], strict=True) if b > a]


def tagged_spans(texts: Texts, model: Model) -> list[tuple[int, int, int]]:
    """(row, byte start, byte end) of each tagged span, outer punctuation left off."""
    if len(texts) == 1 and len(texts.data) > CHUNK_BYTES:
        return _long_spans(texts, model)
    tokens = tokenise(texts, model.keywords, model.file_features)
    if not len(tokens.start):
        return []
    tags = viterbi(emissions(tokens.features, model.emit), model.trans, tokens.bounds)
    at = np.flatnonzero(tags != OUTSIDE)
    row = np.searchsorted(tokens.bounds, at, "right") - 1
    origin = texts.offsets[row]
    return _tagged(tags[at], row, tokens.core_start[at] - origin, tokens.core_end[at] - origin, at)


#: Words that templates look back and ahead.
BACK, AHEAD = 2, 1


def _long_spans(texts: Texts, model: Model) -> list[tuple[int, int, int]]:
    """The same for one long text, piece by piece.

    A piece is read with the words that its first and last tokens' templates look
    at.  Its chain is decoded up to its last token that is outside in every best
    path; the rest waits for the next piece.
    """
    of_file = None
    if model.file_features:
        counts = np.zeros(3, np.int64)
        for _, piece in word_pieces(texts):
            tokens = tokenise(piece, model.keywords, True)
            counts += [tokens.digits, tokens.signs, len(tokens.start)]
        of_file = int(file_value(*counts))
    sure = slack(model.trans)
    none = np.zeros(0, np.int64)
    found = [(np.zeros(0, np.int8), none, none, none)]
    held_score, held_start, held_end, seen = np.zeros((0, TAGS)), none, none, 0

    def decode(upto: int) -> None:
        nonlocal held_score, held_start, held_end, seen
        tags = viterbi(held_score, model.trans, np.array([0, len(held_score)]))[:upto]
        at = np.flatnonzero(tags != OUTSIDE)
        found.append((tags[at], held_start[at], held_end[at], seen + at))
        held_score, held_start, held_end, seen = held_score[upto:], held_start[upto:], held_end[upto:], seen + upto

    spans = [(at, at + len(piece.data)) for at, piece in word_pieces(texts)]
    for low, high in spans:
        before, after = _reach(texts.data, low, high)
        part = Texts(texts.data[before:after], np.array([0, after - before]), 0)
        tokens = tokenise(part, model.keywords, model.file_features, of_file)
        own = np.flatnonzero((tokens.start + before >= low) & (tokens.start + before < high))
        score = emissions(tokens.features[own], model.emit)
        held_score = np.concatenate((held_score, score))
        held_start = np.concatenate((held_start, tokens.core_start[own] + before))
        held_end = np.concatenate((held_end, tokens.core_end[own] + before))
        margin = held_score[:, OUTSIDE] - np.maximum(held_score[:, BEGIN], held_score[:, INSIDE])
        outside = np.flatnonzero(margin > sure)
        if len(outside):
            decode(int(outside[-1]))  # that token stays, as what stands before the rest
    decode(len(held_score))
    tags, start, end, place = (np.concatenate(x) for x in zip(*found, strict=True))
    return _tagged(tags, np.zeros(len(tags), np.int64), start, end, place)


def _reach(data: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """The piece's bounds widened by BACK words before it and AHEAD words after it."""
    blank = lambda i: data[i] == 0x20 or 0x09 <= data[i] <= 0x0D
    for _ in range(BACK):
        while low > 0 and blank(low - 1):
            low -= 1
        while low > 0 and not blank(low - 1):
            low -= 1
    for _ in range(AHEAD):
        while high < len(data) and blank(high):
            high += 1
        while high < len(data) and not blank(high):
            high += 1
    return low, high

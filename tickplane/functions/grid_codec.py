"""Edit commands for grids of (glyph, foreground, background) cells.

A state is an ``(n, 3)`` uint8 array in row-major order.  Two command languages
exist: *plain* commands with byte tokens and a token dictionary, parsed
greedily, and *packed* commands with bit-packed fields and single components,
parsed at the least cost.  Runs are found for the whole grid at once; only the
choice of commands walks from cell to cell.
"""

from __future__ import annotations

import functools
from collections import Counter
from dataclasses import dataclass

import numpy as np

from tickplane.functions.bits import FormatError, get_varuint, pack_low_first, put_varuint, unpack_low_first

GLYPHS = 64
#: Opcodes of the plain commands.
END, SKIP, LITERAL, REPEAT, FILL, DEFINE, INDEXED = range(7)
#: Opcodes of the packed commands, by name in the order of their numbers.
PACKED = ("end", "skip", "literal", "repeat", "glyph", "fore", "back", "pair", "repeat glyph", "repeat fore", "repeat back", "repeat pair")
MOST_DICTIONARY = 64
LONG_RUN = 4
LITERAL_RUN = 64

# Which of the three parts a component command sets.
_PARTS = {"glyph": (0,), "fore": (1,), "back": (2,), "pair": (1, 2)}
_CHANGED = {(True, False, False): "glyph", (False, True, False): "fore", (False, False, True): "back", (False, True, True): "pair"}


def codes(state: np.ndarray) -> np.ndarray:
    """One integer for each cell."""
    wide = state.astype(np.int64)
    return wide[:, 0] << 16 | wide[:, 1] << 8 | wide[:, 2]


def check_state(state: np.ndarray, depth: int) -> None:
    if len(state) and ((state[:, 0] >= GLYPHS).any() or (state[:, 1:] >= depth).any()):
        raise FormatError("cell out of range")


def runs_from(same_as_next: np.ndarray) -> np.ndarray:
    """For each place the length of the run that starts there; the last flag must be false."""
    n = len(same_as_next)
    stops = np.flatnonzero(~same_as_next)
    return stops[np.searchsorted(stops, np.arange(n))] - np.arange(n) + 1


def _joined_runs(keys: np.ndarray, joins: np.ndarray | None = None) -> np.ndarray:
    """Runs of equal keys, where ``joins`` (if given) lets a cell belong to the run before it."""
    same = np.zeros(len(keys), bool)
    same[:-1] = keys[1:] == keys[:-1]
    if joins is not None:
        same[:-1] &= joins[1:]
    return runs_from(same)


def dictionary_for(tokens: np.ndarray) -> list[int]:
    """Tokens that occur twice or more, commonest first, if naming them saves bytes.

    Equal counts go by the token written in decimal with commas.
    """
    text = lambda t: f"{t >> 16},{t >> 8 & 255},{t & 255}"
    common = sorted(((n, t) for t, n in Counter(tokens.tolist()).items() if n >= 2), key=lambda x: (-x[0], text(x[1])))[:MOST_DICTIONARY]
    return [t for _, t in common] if sum(2 * n for n, _ in common) - 3 * len(common) - 3 > 0 else []


def plain_encode(state: np.ndarray, before: np.ndarray | None, columns: int, depth: int, use_dictionary: bool = True) -> bytes:
    """Plain commands for a state; ``before`` is None for a keyframe."""
    check_state(state, depth)
    n, now = len(state), codes(state)
    if before is None and (now == now[0]).all():
        return bytes([FILL]) + b"".join(map(put_varuint, (0, 0, columns, n // columns))) + state[0].tobytes() + bytes([END])
    kept = np.zeros(n, bool) if before is None else now == codes(before)
    names = dictionary_for(now[~kept]) if use_dictionary else []
    number = {t: i for i, t in enumerate(names)}
    out = bytearray()
    if names:
        out += bytes([DEFINE]) + put_varuint(len(names)) + b"".join(t.to_bytes(3, "big") for t in names)
    idle = runs_from(np.append(kept[:-1] & kept[1:], False))
    alike = _joined_runs(now, ~kept)
    # A literal looks ahead at equal tokens whether or not they are kept.
    alike_anyhow = _joined_runs(now)
    named = np.isin(now, names) if names else np.zeros(n, bool)
    # Where a run of indices or of literal cells must stop.
    ends_named = kept | (alike >= LONG_RUN) | ~named
    ends_literal = kept | (alike_anyhow >= LONG_RUN) | named
    stop_named, stop_literal = np.append(np.flatnonzero(ends_named), n), np.append(np.flatnonzero(ends_literal), n)
    at = 0
    while at < n:
        if kept[at]:
            size = int(idle[at])
            out += bytes([SKIP]) + put_varuint(size)
        elif alike[at] >= LONG_RUN:
            size = int(alike[at])
            out += bytes([REPEAT]) + put_varuint(size) + state[at].tobytes()
        elif named[at]:
            size = int(stop_named[np.searchsorted(stop_named, at)]) - at
            out += bytes([INDEXED]) + put_varuint(size) + bytes(number[t] for t in now[at : at + size].tolist())
        else:
            size = int(stop_literal[np.searchsorted(stop_literal, at + 1)]) - at
            out += bytes([LITERAL]) + put_varuint(size) + state[at : at + size].tobytes()
        at += size
    return bytes(out) + bytes([END])


def plain_commands(raw: bytes, n: int, columns: int, depth: int) -> list[tuple[int, int, int, np.ndarray]]:
    """(opcode, first cell, cells, tokens) of plain commands, checked.

    A rectangle's first cell is its corner and ``tokens`` its one token followed
    by its width and height as a row of its own.
    """
    out, at, cell, names = [], 0, 0, None

    def tokens(count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(raw[at : at + 3 * count], np.uint8)
        if len(found) != 3 * count:
            raise FormatError("truncated token")
        at += 3 * count
        check_state(found := found.reshape(-1, 3), depth)
        return found

    def number() -> int:
        nonlocal at
        value, at = get_varuint(raw, at)
        return value

    while at < len(raw):
        op, at = raw[at], at + 1
        if op == END:
            if at != len(raw):
                raise FormatError("bytes after the end")
            return [*out, (END, cell, 0, np.zeros((0, 3), np.uint8))]
        if op == FILL:
            x, y, w, h = number(), number(), number(), number()
            if not w or not h or x + w > columns or (y + h) * columns > n:
                raise FormatError("rectangle")
            out.append((FILL, y * columns + x, w * h, np.concatenate((tokens(1).astype(np.int64), [[w, h, 0]]))))
            continue
        count = number() if op in (SKIP, LITERAL, REPEAT, DEFINE, INDEXED) else 0
        if not count or (op != DEFINE and cell + count > n) or (op == DEFINE and count > MOST_DICTIONARY):
            raise FormatError("command or count")
        if op == DEFINE:
            names = tokens(count)
            out.append((DEFINE, cell, 0, names))
            continue
        if op == INDEXED:
            picked = np.frombuffer(raw[at : at + count], np.uint8)
            if names is None or len(picked) != count or (picked >= len(names)).any():
                raise FormatError("dictionary")
            at += count
            values = names[picked]
        else:
            values = tokens({SKIP: 0, LITERAL: count, REPEAT: 1}[op])
        out.append((op, cell, count, values))
        cell += count
    raise FormatError("no end")


def plain_apply(raw: bytes, before: np.ndarray | None, n: int, columns: int, depth: int) -> np.ndarray:
    """The state after plain commands; the one before is left as it is."""
    state = np.zeros((n, 3), np.uint8) if before is None else before.copy()
    set_ = np.zeros(n, bool)
    for op, cell, count, values in plain_commands(raw, n, columns, depth):
        if op == FILL:
            width, height = (int(v) for v in values[1][:2])
            where = (cell + np.arange(height)[:, None] * columns + np.arange(width)).ravel()
            state[where], set_[where] = values[0], True
        elif op in (LITERAL, REPEAT, INDEXED):
            state[cell : cell + count], set_[cell : cell + count] = values, True
    if before is None and not set_.all():
        raise FormatError("a keyframe sets every cell")
    return state


def index_bits(depth: int) -> int:
    return (depth - 1).bit_length()


@dataclass
class Packed:
    """A packed command: its name, first cell, cells and field values."""

    name: str
    cell: int
    count: int
    values: np.ndarray

    def encode(self, bits: int) -> bytes:
        out = bytes([PACKED.index(self.name)])
        if self.name in ("skip", "literal", "repeat") or self.name.startswith("repeat "):
            out += put_varuint(self.count)
        if self.name == "literal":
            return out + pack_low_first(self.values, _widths(self.name, self.count, bits))
        packed, at = 0, 0  # three fields at most
        for value, glyph in zip(self.values, _glyph_fields(self.name, 1), strict=True):
            packed |= int(value) << at
            at += 6 if glyph else bits
        return out + packed.to_bytes(-(-at // 8), "little")


def _widths(name: str, count: int, bits: int) -> np.ndarray:
    if name in ("literal", "repeat"):
        return np.tile([6, bits, bits], count if name == "literal" else 1)
    return np.array([6 if p == 0 else bits for p in _PARTS.get(name.removeprefix("repeat "), ())], np.int64)


@functools.lru_cache(maxsize=4096)
def _glyph_fields(name: str, count: int) -> np.ndarray:
    if name in ("literal", "repeat"):
        return np.tile([True, False, False], count if name == "literal" else 1)
    return np.array([p == 0 for p in _PARTS.get(name.removeprefix("repeat "), ())], bool)


def _varuint_size(n):
    return np.maximum(1, -(-np.floor(np.log2(np.maximum(n, 1)) + 1).astype(int) // 7))


def packed_plan(state: np.ndarray, before: np.ndarray | None, depth: int, literal_run: int = LITERAL_RUN, byte_costs: np.ndarray | None = None) -> list[Packed]:
    """The cheapest packed commands for a state.

    The cost is bytes, or bits by ``byte_costs`` (a cost for each byte value).
    Of equal costs the shorter form in bytes (if weighted), then the longer run,
    then skips, component runs, token runs, single components, literals.  A
    keyframe starts from a grid of zeros, which may be skipped.
    """
    check_state(state, depth)
    n, bits = len(state), index_bits(depth)
    base = np.zeros_like(state) if before is None else before
    differs = state != base
    kept = ~differs.any(1)
    idle = runs_from(np.append(kept[:-1] & kept[1:], False))
    alike = _joined_runs(codes(state))
    kinds = [_CHANGED.get(tuple(d)) if before is not None else None for d in differs.tolist()]
    order = {None: 0, "glyph": 1, "fore": 2, "back": 3, "pair": 4}
    kind_no = np.array([order[k] for k in kinds])
    masks = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1], [0, 1, 1]])
    component = kind_no << 24 | codes((state * masks[kind_no]).astype(np.uint8))
    component_run = _joined_runs(component)
    token_bits = 6 + 2 * bits
    lengths = np.arange(1, literal_run + 1)
    literal_size = 1 + _varuint_size(lengths) + -(-lengths * token_bits // 8)
    literal_heads = [bytes([PACKED.index("literal")]) + put_varuint(c) for c in lengths.tolist()]
    head_costs = None if byte_costs is None else np.array([byte_costs[list(h)].sum() for h in literal_heads])
    cell_bits = None
    if byte_costs is not None:
        fields = state.astype(np.int64)
        cell_bits = np.concatenate([(fields[:, i : i + 1] >> np.arange(w)) & 1 for i, w in enumerate((6, bits, bits))], 1).astype(np.uint8)
    prices = None if byte_costs is None else byte_costs.tolist()
    best = np.zeros(n + 1)
    best[n] = 1.0 if byte_costs is None else byte_costs[PACKED.index("end")]
    chosen: list[Packed | int] = [0] * n

    def price(command: Packed) -> tuple[float, int]:
        raw = command.encode(bits)
        return (float(len(raw)) if prices is None else sum(prices[b] for b in raw)), len(raw)

    for at in range(n - 1, -1, -1):
        most = min(literal_run, n - at)
        if byte_costs is None:
            literal = literal_size[:most] + best[at + 1 : at + 1 + most]
        else:
            flat = cell_bits[at : at + most].ravel()
            whole = np.packbits(flat, bitorder="little")
            spent = np.concatenate(([0.0], np.cumsum(byte_costs[whole])))
            used = lengths[:most] * token_bits
            full, rest = used // 8, used % 8
            part = whole[np.minimum(full, len(whole) - 1)] & ((1 << rest) - 1)
            literal = head_costs[:most] + spent[full] + np.where(rest > 0, byte_costs[part], 0) + best[at + 1 : at + 1 + most]
        options: list[tuple[float, int, int, int, Packed | int]] = []
        floor = literal.min()
        near = np.flatnonzero(literal < floor + 1e-9)
        pick = int(near[-1]) if byte_costs is None else int(min(near, key=lambda i: (literal_size[i], -i)))
        options.append((float(literal[pick]), int(literal_size[pick]), -(pick + 1), 4, pick + 1))
        tries = []
        if kept[at]:
            tries.append((0, Packed("skip", at, int(idle[at]), state[:0, 0])))
        if alike[at] >= 2:
            tries.append((2, Packed("repeat", at, int(alike[at]), state[at])))
        if kinds[at]:
            values = state[at][list(_PARTS[kinds[at]])]
            tries.append((3, Packed(kinds[at], at, 1, values)))
            if component_run[at] >= 2:
                tries.append((1, Packed(f"repeat {kinds[at]}", at, int(component_run[at]), values)))
        for rank, command in tries:
            cost, size = price(command)
            options.append((cost + best[at + command.count], size, -command.count, rank, command))
        least = min(o[0] for o in options)
        tie = (lambda o: (o[1], o[2], o[3])) if byte_costs is not None else (lambda o: (o[2], o[3]))
        total, *_, command = min((o for o in options if o[0] < least + 1e-9), key=tie)
        best[at], chosen[at] = total, command
    out, at = [], 0
    while at < n:
        command = chosen[at]
        if isinstance(command, int):
            command = Packed("literal", at, command, state[at : at + command].ravel())
        out.append(command)
        at += command.count
    return [*out, Packed("end", n, 0, state[:0, 0])]


def packed_encode(plan: list[Packed], depth: int) -> bytes:
    return b"".join(c.encode(index_bits(depth)) for c in plan)


def packed_commands(raw: bytes, n: int, depth: int) -> list[Packed]:
    """The packed commands of a frame, checked; at most 2n + 1 of them."""
    bits, out, at, cell = index_bits(depth), [], 0, 0
    while at < len(raw):
        if raw[at] >= len(PACKED) or len(out) > 2 * n:
            raise FormatError("packed opcode or too many commands")
        name, at = PACKED[raw[at]], at + 1
        if name == "end":
            if at != len(raw):
                raise FormatError("bytes after the end")
            return [*out, Packed("end", cell, 0, np.zeros(0, np.int64))]
        count = 1
        if name in ("skip", "literal", "repeat") or name.startswith("repeat "):
            count, at = get_varuint(raw, at)
        if not count or cell + count > n:
            raise FormatError("packed run")
        widths = _widths(name, count, bits)
        size = -(-int(widths.sum()) // 8)
        if at + size > len(raw):
            raise FormatError("truncated fields")
        values = unpack_low_first(raw[at : at + size], widths)
        at += size
        glyph = _glyph_fields(name, count)
        if (values[~glyph] >= depth).any():
            raise FormatError("palette index")
        out.append(Packed(name, cell, count, values))
        cell += count
    raise FormatError("no end")


def packed_apply(raw: bytes, before: np.ndarray | None, n: int, depth: int) -> np.ndarray:
    state = np.zeros((n, 3), np.uint8) if before is None else before.copy()
    for c in packed_commands(raw, n, depth):
        if c.name in ("literal", "repeat"):
            state[c.cell : c.cell + c.count] = c.values.reshape(-1, 3)
        elif parts := _PARTS.get(c.name.removeprefix("repeat ")):
            state[c.cell : c.cell + c.count, list(parts)] = c.values
    return state


#: States that are parsed side by side, and their cells in all, bound what a slice of them holds.
SIDE_BY_SIDE, CELLS_AT_ONCE = 2048, 1 << 18
# The part of a cell's changes by pattern (glyph 1, fore 2, back 4), as in _CHANGED; 0 is none.
_KIND_OF = np.array([0, 1, 2, 0, 3, 0, 4, 0])
_KIND_MASK = np.array([0, 0xFF0000, 0x00FF00, 0x0000FF, 0x00FFFF])
_SKIP, _PART_RUN, _REPEAT, _PART, _LITERAL, _END = range(6)


def _fields(states: np.ndarray) -> np.ndarray:
    """(part, cell, state) of (state, cell, part)."""
    return np.ascontiguousarray(states.transpose(2, 1, 0)).astype(np.int64)


def _same_after(keys: np.ndarray) -> np.ndarray:
    same = np.zeros(keys.shape, bool)
    same[:-1] = keys[1:] == keys[:-1]
    return same


def _run_lengths(same: np.ndarray) -> np.ndarray:
    """``runs_from`` for the cells of many states, cells going down."""
    out = np.ones(same.shape, np.int64)
    for at in range(len(same) - 2, -1, -1):
        out[at] += np.where(same[at], out[at + 1], 0)
    return out


def _walked(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state, cell) where each state's commands begin, the end included, if one at a cell takes ``counts`` cells."""
    n, size = counts.shape
    live, cell = np.arange(size), np.zeros(size, np.int64)
    found = []
    while len(live):
        found.append(live * (n + 1) + cell)
        cell = cell + counts[cell, live]
        live, cell = live[cell < n], cell[cell < n]
    every = np.sort(np.concatenate([*found, np.arange(size) * (n + 1) + n]))
    return every // (n + 1), every % (n + 1)


def _put_numbers(out: np.ndarray, at: np.ndarray, values: np.ndarray, sizes: np.ndarray, base_128: bool) -> None:
    """Numbers of so many bytes at their places, lowest first."""
    shift = 7 if base_128 else 8
    for j in range(int(sizes.max(initial=0))):
        on = np.flatnonzero(sizes > j)
        byte = values[on] >> shift * j
        out[at[on] + j] = (byte & 0x7F) | np.where(sizes[on] > j + 1, 0x80, 0) if base_128 else byte & 0xFF


def _within(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) of each of ``sizes`` items."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _sliced(one, states: np.ndarray, *others: np.ndarray | None) -> tuple[bytes, np.ndarray]:
    size, parts, ends, total = max(1, min(SIDE_BY_SIDE, CELLS_AT_ONCE // max(1, states.shape[1]))), [], [np.zeros(1, np.int64)], 0
    for at in range(0, len(states), size):
        data, end = one(*(None if x is None else x[at : at + size] for x in (states, *others)))
        parts.append(data)
        ends.append(end + total)
        total += len(data)
    return b"".join(parts), np.concatenate(ends)


def packed_streams(states: np.ndarray, before: np.ndarray, keyed: np.ndarray, depth: int, literal_run: int = LITERAL_RUN, byte_costs: np.ndarray | None = None, owner: np.ndarray | None = None) -> tuple[bytes, np.ndarray]:
    """(bytes, places) of many states' packed commands; state i has those from places[i] to places[i + 1].

    They are what ``packed_encode`` makes of ``packed_plan``, found for all states
    side by side.  States are (state, cell, part), ``keyed`` ones are keyframes;
    ``byte_costs`` has rows of costs and ``owner`` each state's row.
    """
    check_state(states.reshape(-1, 3), depth)
    costs = None if byte_costs is None else np.ascontiguousarray(byte_costs)
    return _sliced(lambda s, b, k, o: _packed_slice(s, b, k, depth, literal_run, costs, o), states, before, keyed, owner)


def _packed_slice(states: np.ndarray, before: np.ndarray, keyed: np.ndarray, depth: int, literal_run: int, costs: np.ndarray | None, owner: np.ndarray | None) -> tuple[bytes, np.ndarray]:
    size, n = states.shape[:2]
    bits = index_bits(depth)
    width = 6 + 2 * bits
    part = _fields(states)
    differs = part != np.where(keyed, 0, _fields(before))
    kept = ~differs.any(0)
    kind = np.where(keyed, 0, _KIND_OF[differs[0] + 2 * differs[1] + 4 * differs[2]])
    code = part[0] << 16 | part[1] << 8 | part[2]
    same = {_SKIP: np.concatenate((kept[:-1] & kept[1:], np.zeros((1, size), bool))), _REPEAT: _same_after(code), _PART_RUN: _same_after(kind << 24 | code & _KIND_MASK[kind])}
    runs = {k: _run_lengths(v) for k, v in same.items()}
    token = np.zeros((n + 2, size), np.int64)
    token[:n] = part[0] | part[1] << 6 | part[2] << 6 + bits
    value = np.choose(kind, [token[:n], part[0], part[1], part[2], part[1] | part[2] << bits])
    value_size = -(-np.array([0, 6, bits, bits, 2 * bits]) // 8)[kind]
    token_size = -(-width // 8)
    counted = _varuint_size(np.arange(n + 1))
    sizes = {_SKIP: 1 + counted[runs[_SKIP]], _PART_RUN: 1 + counted[runs[_PART_RUN]] + value_size, _REPEAT: 1 + counted[runs[_REPEAT]] + token_size, _PART: 1 + value_size}
    runs[_PART] = np.ones((n, size), np.int64)
    able = {_SKIP: kept, _PART_RUN: (kind > 0) & (runs[_PART_RUN] >= 2), _REPEAT: runs[_REPEAT] >= 2, _PART: kind > 0}
    lengths = np.arange(1, min(literal_run, n) + 1)
    literal_size = 1 + counted[lengths] + -(-lengths * width // 8)
    # An option's key puts longer runs first, then the lower number; the cost (or size) stands above it.
    unit = 1 << int(8 * (n + 1)).bit_length()
    below = lambda count, number: (n - count) * 8 + number
    literal_key = (literal_size * unit + below(lengths, _LITERAL))[:, None]
    none = np.int64(1) << 62
    keys = {k: np.where(able[k], sizes[k] * unit + below(runs[k], k), none) for k in able}
    chosen = np.empty((n, size), np.int64)
    tail: dict[int, np.ndarray] = {}
    if costs is None:
        best = np.zeros((n + 1, size), np.int64)
        best[n] = unit
        for at in range(n - 1, -1, -1):
            most = min(len(lengths), n - at)
            least = (best[at + 1 : at + 1 + most] + literal_key[:most]).min(0)
            for k in same:
                tail[k] = np.where(same[k][at], tail[k], best[at + 1]) if tail.get(k) is not None else best[at + 1]
                np.minimum(least, keys[k][at] + tail[k], out=least)
            np.minimum(least, keys[_PART][at] + best[at + 1], out=least)
            chosen[at] = least & unit - 1
            best[at] = least - chosen[at]
    else:
        flat, row = costs.ravel(), owner.astype(np.int64) * costs.shape[1]
        cost = lambda byte: flat[row + byte]

        def number_cost(count: np.ndarray) -> np.ndarray:
            out, used = 0.0, counted[count]
            for j in range(int(counted[-1])):
                out = out + np.where(used > j, cost((count >> 7 * j & 0x7F) | np.where(used > j + 1, 0x80, 0)), 0.0)
            return out

        def value_cost(values: np.ndarray, used: np.ndarray) -> np.ndarray:
            out = 0.0
            for j in range(int(used.max())):
                out = out + np.where(used > j, cost(values >> 8 * j & 0xFF), 0.0)
            return out

        part_cost = value_cost(value, value_size)
        prices = {
            _SKIP: cost(1) + number_cost(runs[_SKIP]), _PART_RUN: cost(7 + kind) + number_cost(runs[_PART_RUN]) + part_cost,
            _REPEAT: cost(3) + number_cost(runs[_REPEAT]) + value_cost(token[:n], np.full((n, size), token_size)), _PART: cost(3 + kind) + part_cost,
        }
        prices = {k: np.where(able[k], v, np.inf) for k, v in prices.items()}
        head = cost(2) + number_cost(np.repeat(lengths[:, None], size, 1))
        # A literal's byte is told by the cell and the bit of it where it begins, the last by the cell and the bits left.
        full, rest = lengths * width // 8, lengths * width % 8
        byte_at = np.arange(int(full[-1])) * 8
        cell_of, bit_of = byte_at // width, byte_at % width
        bit_kinds, bit_no = np.unique(bit_of, return_inverse=True)
        spent_by = np.stack([cost((token[:n] >> b | token[1 : n + 1] << width - b | token[2:] << 2 * width - b) & 0xFF) for b in bit_kinds.tolist()]) if len(byte_at) else np.zeros((1, n, size))
        rest_kinds, rest_no = np.unique(rest, return_inverse=True)
        rest_by = np.stack([cost(token[:n] >> width - r) if r else np.zeros((n, size)) for r in rest_kinds.tolist()])
        literal_tie = (literal_size * unit - lengths)[:, None]
        best = np.zeros((n + 1, size))
        best[n] = cost(0)
        spent = np.zeros((len(byte_at) + 1, size))
        columns = np.arange(size)
        for at in range(n - 1, -1, -1):
            most = min(len(lengths), n - at)
            whole = int(full[most - 1])
            np.cumsum(spent_by[bit_no[:whole], at + cell_of[:whole]], axis=0, out=spent[1 : whole + 1])
            literal = head[:most] + spent[full[:most]]
            literal += rest_by[rest_no[:most], at + lengths[:most] - 1]
            literal += best[at + 1 : at + 1 + most]
            tie = np.where(literal < literal.min(0) + 1e-9, literal_tie[:most], none).min(0)
            pick = -tie % unit  # the length
            totals, ties = [literal[pick - 1, columns]], [(tie + pick) + below(pick, _LITERAL)]
            for k in same:
                tail[k] = np.where(same[k][at], tail[k], best[at + 1]) if tail.get(k) is not None else best[at + 1]
            for k in able:
                totals.append(prices[k][at] + (tail[k] if k in tail else best[at + 1]))
                ties.append(keys[k][at])
            totals, ties = np.stack(totals), np.stack(ties)
            won = np.where(totals < totals.min(0) + 1e-9, ties, none).argmin(0)
            best[at], chosen[at] = totals[won, columns], ties[won, columns] & unit - 1
    state, cell = _walked(n - (chosen >> 3))
    end = cell == n
    inner = np.minimum(cell, n - 1)
    key = chosen[inner, state]
    form, count = np.where(end, _END, key & 7), np.where(end, 0, n - (key >> 3))
    kinds = kind[inner, state]
    opcode = np.choose(form, [np.int64(1), 7 + kinds, np.int64(3), 3 + kinds, np.int64(2), np.int64(0)])
    head_size = np.where((form == _PART) | end, 0, counted[count])
    literal = form == _LITERAL
    value_sizes = value_size[inner, state]
    body = np.choose(form, [np.int64(0), value_sizes, np.int64(token_size), value_sizes, -(-count * width // 8), np.int64(0)])
    whole = 1 + head_size + body
    stop = np.cumsum(whole)
    start = stop - whole
    out = np.zeros(int(stop[-1]), np.uint8)
    out[start] = opcode
    _put_numbers(out, start + 1, count, head_size, True)
    _put_numbers(out, start + 1 + head_size, np.where(form == _REPEAT, token[inner, state], value[inner, state]), np.where(literal, 0, body), False)
    put = np.flatnonzero(literal)
    own, place = _within(body[put])
    own = put[own]
    first, bit = cell[own] + place * 8 // width, place * 8 % width
    byte = token[first, state[own]] >> bit
    for j in (1, 2):
        byte |= np.where(first + j < cell[own] + count[own], token[np.minimum(first + j, n), state[own]], 0) << j * width - bit
    out[start[own] + 1 + head_size[own] + place] = byte & 0xFF
    return out.tobytes(), stop[end]


def plain_streams(states: np.ndarray, before: np.ndarray, keyed: np.ndarray, columns: int, depth: int) -> tuple[bytes, np.ndarray]:
    """(bytes, places) of many states' plain commands, as ``plain_encode`` makes them one by one.

    States of which no token is written twice have no dictionary and no repeats, and
    are parsed side by side; the others go one by one.
    """
    check_state(states.reshape(-1, 3), depth)
    return _sliced(lambda s, b, k: _plain_slice(s, b, k, columns, depth), states, before, keyed)


def _plain_slice(states: np.ndarray, before: np.ndarray, keyed: np.ndarray, columns: int, depth: int) -> tuple[bytes, np.ndarray]:
    part, old = _fields(states), _fields(before)
    now = part[0] << 16 | part[1] << 8 | part[2]
    kept = (now == (old[0] << 16 | old[1] << 8 | old[2])) & ~keyed
    n = len(now)
    written = np.sort(np.where(kept, -1 - np.arange(n)[:, None], now), axis=0)
    easy = np.flatnonzero((written[1:] != written[:-1]).all(0) & ~(keyed & (now == now[0]).all(0)))
    now, kept = now[:, easy], kept[:, easy]
    idle = _run_lengths(np.concatenate((kept[:-1] & kept[1:], np.zeros((1, len(easy)), bool))))
    stops = kept | (_run_lengths(_same_after(now)) >= LONG_RUN)
    goes_on = np.zeros(stops.shape, bool)
    goes_on[:-1] = ~stops[1:]
    state, cell = _walked(np.where(kept, idle, _run_lengths(goes_on)))
    end = cell == n
    inner = np.minimum(cell, n - 1)
    skip = kept[inner, state] & ~end
    count = np.where(end, 0, np.where(skip, idle[inner, state], _run_lengths(goes_on)[inner, state]))
    head = np.where(end, 0, _varuint_size(np.arange(n + 1))[count])
    body = np.where(skip, 0, 3 * count)
    stop = np.cumsum(1 + head + body)
    start = stop - (1 + head + body)
    out = np.zeros(int(stop[-1]) if len(stop) else 0, np.uint8)
    out[start] = np.where(end, END, np.where(skip, SKIP, LITERAL))
    _put_numbers(out, start + 1, count, head, True)
    own, place = _within(body)
    out[start[own] + 1 + head[own] + place] = states[easy[state[own]], cell[own] + place // 3, place % 3]
    data, stop = out.tobytes(), stop[end]
    made: list[bytes] = [b""] * len(states)
    for i, a, b in zip(easy.tolist(), [0, *stop.tolist()[:-1]], stop.tolist(), strict=False):
        made[i] = data[a:b]
    one_by_one = np.ones(len(states), bool)
    one_by_one[easy] = False
    for i in np.flatnonzero(one_by_one).tolist():
        made[i] = plain_encode(states[i], None if keyed[i] else before[i], columns, depth)
    return b"".join(made), np.cumsum([len(x) for x in made])


def cut(data: bytes, places: np.ndarray) -> list[bytes]:
    """The pieces between the places."""
    at = places.tolist()
    return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

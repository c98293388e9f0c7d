"""Byte-level BPE through a sentencepiece model made from a rank file.

The vocabulary's byte strings are written with one printable character per byte
and become the pieces of a BPE model; a piece's score is its negative rank, so
sentencepiece merges what the rank file would merge, leftmost first.  The
normaliser is the identity.  No tokenizer is trained.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import operator
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tickplane.llm.textkernel import CHUNK_BYTES, text_chunks, tidy

#: Pre-tokens whose ids a task remembers.
REMEMBERED = 60_000
#: Characters from which on a text is long, and the pre-tokens and ids of it that are handled at once.
LONG, TAKEN = CHUNK_BYTES, 40_000


@functools.cache
def byte_alphabet() -> tuple[str, ...]:
    """A printable character for each byte: Latin-1's own where printable, else the next free one from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return tuple(chr(b) if b in own else chr(next(free)) for b in range(256))


def read_ranks(raw: bytes) -> list[bytes]:
    """Byte strings in rank order from lines of base64 and rank."""
    pairs = (line.split() for line in raw.splitlines() if line.strip())
    ranks = {int(rank): base64.b64decode(piece) for piece, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0 to n - 1")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, raw: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(raw)) + raw


def _float(field: int, x: float) -> bytes:
    return _varint(field << 3 | 5) + struct.pack("<f", x)


def serialise_model(pieces: list[bytes]) -> bytes:
    """A sentencepiece ModelProto; piece i of the rank file has id i + 1.

    Field numbers are those of the public sentencepiece_model.proto.
    """
    normal, unknown, bpe = 1, 2, 2
    alphabet = byte_alphabet()
    unknown_piece = "⁇⁇"  # not writable in the byte alphabet
    out = [_bytes(1, _bytes(1, unknown_piece.encode()) + _float(2, 0.0) + _number(3, unknown))]
    for rank, piece in enumerate(pieces):
        text = "".join(alphabet[b] for b in piece).encode()
        out.append(_bytes(1, _bytes(1, text) + _float(2, -float(rank)) + _number(3, normal)))
    trainer = _number(3, bpe) + _number(4, len(pieces) + 1) + _number(40, 0) + b"".join(_number(f, -1) for f in (41, 42, 43)) + _bytes(45, unknown_piece.encode())
    normaliser = _bytes(1, b"identity") + b"".join(_number(f, 0) for f in (3, 4, 5))
    return b"".join(out) + _bytes(2, trainer) + _bytes(3, normaliser)


class ByteBpe(dict):
    """Remembered pre-tokens with their little-endian ids; encodes and decodes."""

    def __init__(self, rank_file: bytes, pattern: str):
        import regex
        import sentencepiece

        super().__init__()
        self.pieces = read_ranks(rank_file)
        self.ranks = {piece: i for i, piece in enumerate(self.pieces)}
        compiled = regex.compile(pattern)
        self.split, self.matches = compiled.findall, compiled.finditer
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.pieces))
        self.table = {b: c for b, c in enumerate(byte_alphabet())}

    def learn(self, tokens: set[str]) -> None:
        """Remember the ids of these pre-tokens; the new ones are encoded in one call."""
        new = [t for t in tokens if t not in self]
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = list(tokens)
        merged = []
        for token in new:
            rank = self.ranks.get(raw := token.encode())
            if rank is None:
                merged.append((token, raw.decode("latin-1").translate(self.table)))
            else:  # a pre-token that is itself a piece is not merged
                self[token] = struct.pack("<I", rank)
        found = self.model.encode([x for _, x in merged], num_threads=1)
        raw, at = (np.fromiter(itertools.chain.from_iterable(found), "<u4") - np.uint32(1)).tobytes(), 0
        for (token, _), ids in zip(merged, found, strict=True):
            self[token] = raw[at : (at := at + 4 * len(ids))]

    def _encode(self, tokens: list[list[str]]) -> list[bytes]:
        self.learn(set().union(*tokens))
        return [b"".join(map(self.__getitem__, x)) for x in tokens]

    def _encode_long(self, text: str) -> bytes:
        matches = map(operator.itemgetter(0), self.matches(text))
        parts = iter(lambda: list(itertools.islice(matches, TAKEN)), [])
        return b"".join(self._encode([part])[0] for part in parts)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers.

        Short texts go together, a long one in parts of TAKEN pre-tokens.
        """
        done = iter(self._encode([self.split(x) for x in texts if len(x) <= LONG]))
        return [next(done) if len(x) <= LONG else self._encode_long(x) for x in texts]

    def decode(self, ids: bytes) -> bytes:
        numbers = np.frombuffer(ids, "<u4")
        return b"".join(b"".join(map(self.pieces.__getitem__, numbers[at : at + TAKEN].tolist())) for at in range(0, len(numbers), TAKEN))


#: Output columns that ``byte_bpe`` can make, with their types.
OUTPUTS = {
    "ids": T.ArrayType(T.IntegerType()),
    "n_tokens": T.LongType(),
    "decoded": T.StringType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def byte_bpe(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Encode a text column and decode the ids again.

    ``vocabulary`` is the path of a rank file on the driver; its bytes travel
    with the job.  Returns the columns ``keep`` as they are and ``outputs``
    (see OUTPUTS; ``ids`` and ``decoded`` are the token ids and the text that
    they give).  A null text is an empty one: no ids, an empty decoded text.
    Texts of any length are encoded whole; repeated rows and null keys pass
    through; an empty table gives an empty result.
    """
    with open(vocabulary, "rb") as f:
        rank_file = f.read()
    wanted = [T.StructField(c, OUTPUTS[c]) for c in outputs]
    schema = T.StructType([*(docs.schema[c] for c in keep), *wanted])
    # The text goes last and by place, so that no name in ``keep`` clashes with it.
    source = docs.select(*keep, docs[text_col].alias("__text"))
    types = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ByteBpe(rank_file, pattern)
        for batch in batches:
            made: dict[str, list] = {c: [] for c in outputs}
            for ids in (x for part in text_chunks(batch.column(len(keep))) for x in codec.encode_all([part.bytes_of(i).decode() for i in range(len(part))])):
                decoded = codec.decode(ids)
                for c, out in made.items():
                    if c == "ids":
                        out.append(np.frombuffer(ids, "<u4").astype(np.int32))
                    elif c == "n_tokens":
                        out.append(len(ids) // 4)
                    elif c == "decoded":
                        out.append(decoded.decode())
                    else:
                        out.append(hashlib.sha256(ids if c == "ids_sha256" else decoded).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(made[c], types[c]) for c in outputs)], schema.names)

    return source.mapInArrow(tidy(run), schema)

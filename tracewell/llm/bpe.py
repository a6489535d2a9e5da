"""Byte-level BPE through sentencepiece: a model is serialised straight from a vocabulary of ranks.

A rank file lists byte strings by merge rank. Each byte is mapped to a printable character, so every entry is a
piece; its score is its negative rank, and the normaliser is the identity. sentencepiece then joins the adjacent
pair of the best score first, the leftmost among equals, which is the merge order of the ranks. Pre-tokens never
merge with each other: those not met before are encoded together, parted by a character that none of them holds (it comes back as
the unknown id and is taken out); where no character is free, fewer are encoded at a time. Decoding maps each id back to the bytes of its piece.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import row_type

#: Pre-tokens looked up at a time; texts are cut between pre-tokens.
CHUNK_PRETOKENS = 16_384
#: Longer texts are pre-tokenised lazily.
LAZY_CHARS = 1_000_000
#: Pre-tokens whose ids a worker remembers.
CACHED_PRETOKENS = 200_000
PART = "▁"
#: Characters that may part pre-tokens, the likeliest to be free first.
MARKS = [chr(c) for c in range(0xFFFF, 0xE000, -1)]


def byte_characters() -> str:
    """A printable character for each of the 256 bytes: itself if printable in Latin-1, else one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return "".join(chr(b if b in shown else next(spare)) for b in range(256))


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line a base64 byte string and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model (its protobuf) whose id r + 1 is the token of rank r; id 0 is the unknown piece."""
    ordered = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in ordered] != list(range(len(ordered))):
        raise ValueError("ranks must be 0 to n - 1")
    chars = byte_characters()
    unknown, bpe = 2, 2
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)]
    pieces += [_field(1, codecs.charmap_decode(t, "strict", chars)[0].encode()) + _field(2, -float(r)) for r, t in enumerate(ordered)]
    absent = (1 << 64) - 1
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, 0) + b"".join(_field(n, absent) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """Encoder and decoder for one rank file and one pre-token pattern (as the ``regex`` module reads it)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.chars = byte_characters()
        self.find = regex.compile(pattern)
        self.cache: dict[str, bytes] = {}
        self.bytes = self._inverse(len(ranks))
        #: Tokens that the merges alone don't reach; a pre-token equal to one is still one id.
        self.whole = {t: r for t, r in ranks.items() if len(t) > 1 and self.model.encode(self._mapped(t)) != [r + 1]}

    def _mapped(self, data: bytes) -> str:
        return codecs.charmap_decode(data, "strict", self.chars)[0]

    def _inverse(self, n: int) -> list[bytes]:
        back = {c: b for b, c in enumerate(self.chars)}
        return [bytes(back[c] for c in self.model.id_to_piece(i + 1)) for i in range(n)]

    def _pretokens(self, text: str) -> Iterator[list[str]]:
        if len(text) <= LAZY_CHARS:
            found = self.find.findall(text)
            yield from (found[i : i + CHUNK_PRETOKENS] for i in range(0, len(found), CHUNK_PRETOKENS))
            return
        lazy = (m.group() for m in self.find.finditer(text))
        while part := list(islice(lazy, CHUNK_PRETOKENS)):
            yield part

    def _learn(self, pretokens: set[str]) -> None:
        """Put the ids of some pre-tokens into the cache, by one call of the encoder."""
        known = [t for t in pretokens if t.encode() in self.whole] if self.whole else []
        self.cache.update((t, struct.pack("<I", self.whole[t.encode()])) for t in known)
        parts = [list(pretokens.difference(known))]
        while parts:
            fresh = parts.pop()
            mark = next((c for c in MARKS if not any(c in t for t in fresh)), "")
            if mark or len(fresh) < 2:
                self._encode(fresh, mark)
            else:
                parts += [fresh[: len(fresh) // 2], fresh[len(fresh) // 2 :]]

    def _encode(self, fresh: list[str], mark: str) -> None:
        """Put the ids of pre-tokens that don't hold ``mark`` into the cache; a single one needs no mark."""
        mapped = self._mapped(mark.join(fresh).encode())
        ids = np.array(self.model.encode(mapped.replace(self._mapped(mark.encode()), PART) if mark else mapped), dtype=np.int64)
        cuts = np.flatnonzero(ids == 0)
        data, starts, ends = (ids - 1).astype("<u4").tobytes(), [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]
        self.cache.update((t, data[4 * i : 4 * j]) for t, i, j in zip(fresh, starts, ends))

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, as unsigned 32-bit integers; an empty text has none."""
        parts = []
        for pretokens in self._pretokens(text):
            if missing := set(pretokens).difference(self.cache):
                if len(self.cache) > CACHED_PRETOKENS:
                    self.cache.clear()
                    missing = set(pretokens)
                self._learn(missing)
            parts += map(self.cache.__getitem__, pretokens)
        return np.frombuffer(b"".join(parts), "<u4")

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    """One codec for each Python worker."""
    return ByteBpe(load_ranks(path), pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Each row's columns ``keep`` with ``ids`` (array of long) and ``decoded`` (binary, the ids decoded again). A null text counts as empty.

    ``path`` names the rank file on every executor. One pass over whole texts, no shuffle.
    """
    if len(set(keep)) < len(keep) or set(keep) & {"ids", "decoded"}:
        raise ValueError("keep must name different columns, none of them ids or decoded")
    rows = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [bpe.encode(t or "") for t in part.column(len(keep)).to_pylist()]
                decoded = [bpe.decode(i.tolist()) for i in ids]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array([i.astype(np.int64) for i in ids], pa.list_(pa.int64())), pa.array(decoded, pa.binary())], [*keep, "ids", "decoded"])

    return rows.mapInArrow(run, row_type(rows, list(keep), ids="array<bigint>", decoded="binary"))


def encode_checked(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) and whether the ids decode to the text again, of each row; a null text counts as empty."""

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t.as_py() or "" for t in part.column(1)]
                ids = [bpe.encode(t) for t in texts]
                same = [bpe.decode(i.tolist()) == t.encode() for i, t in zip(ids, texts)]
                columns = [pa.array([len(i) for i in ids], pa.int64()), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_tokens", "ids", "decodes"])

    return docs.select("doc_id", "text").mapInArrow(run, row_type(docs, ["doc_id"], n_tokens="bigint", ids="array<int>", decodes="boolean"))


def digest_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The number of ids of each document and digests of its ids and of what they decode to.

    The same pass as ``encode_documents``, with the lists digested where they are made: they never cross to the JVM.
    """

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(bpe.decode(ids.tolist())).hexdigest()))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, row_type(docs, ["doc_id"], n_tokens="bigint", ids_sha256="string", decoded_sha256="string"))

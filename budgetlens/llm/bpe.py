"""Byte-level BPE encoding and decoding through a sentencepiece model that is
serialised directly from a rank file (nothing is trained).

Each byte is mapped to one printable character; every entry of the vocabulary
becomes a piece of mapped characters with score ``-rank``, normalisation is
the identity. Sentencepiece then merges the best-scored adjacent pair first,
leftmost among equals, which is byte-pair encoding by rank. Texts are cut by
the pre-token pattern; each pre-token is encoded alone and equal pre-tokens of
a task share one result. Decoding maps ids back to pieces and characters back
to bytes.

Defined cases: null and empty texts have no ids and decode to nothing; whole
texts of any length are encoded; repeated rows each get their row; other
columns are untouched (but one with the name of a new column is replaced).
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from budgetlens.llm.common import fresh, prepare, read_table, release, slices, with_made

#: Entries of a task's pre-token cache; when full, and at the end of the task, it starts anew.
CACHE = 250_000
#: First of the 256 characters that stand for bytes (a block without white space).
FIRST_CHAR = 0x4E00


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file (base64 token, rank per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}


def byte_chars(data: bytes) -> str:
    return "".join([chr(FIRST_CHAR + b) for b in data])


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value) -> bytes:
    """One protobuf field: bytes, float or non-negative int."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model: pieces in order of rank, their ids
    the ranks, then one piece for unknown input (never met: all 256 bytes are
    pieces)."""
    order = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks must be 0 to n-1")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without a rank: {missing[:5]}")
    pieces = [_field(1, _field(1, byte_chars(t).encode()) + _field(2, -float(r)))
              for r, t in enumerate(order)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = (_field(3, 2) + _field(4, len(order) + 1) + _field(40, len(order))
               + b"".join(_varint(n << 3) + _varint((1 << 64) - 1) for n in (41, 42, 43)))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encoder and decoder of one rank file, with a bounded pre-token cache."""

    def __init__(self, path: str, pattern: str, cache: int = CACHE):
        from sentencepiece import SentencePieceProcessor

        self.ranks = read_ranks(path)
        self.model = SentencePieceProcessor(model_proto=sentencepiece_model(self.ranks))
        self.find = regex.compile(pattern).findall
        self.pieces = [bytes(ord(c) - FIRST_CHAR for c in self.model.id_to_piece(i))
                       for i in range(len(self.ranks))]
        outer = self

        class Cache(dict):
            def __missing__(self, token):
                if len(self) >= cache:
                    self.clear()
                raw = token.encode()
                rank = outer.ranks.get(raw)  # a pre-token that is a token stays whole
                ids = [rank] if rank is not None else outer.model.encode(byte_chars(raw))
                self[token] = packed = struct.pack(f"<{len(ids)}I", *ids)
                return packed

        self.cache = Cache()

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.cache.__getitem__, self.find(text)))

    def decode_packed(self, packed: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, memoryview(packed).cast("I").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per task; the file lies at ``path`` on each machine."""
    return Codec(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    """(rank file, pre-token pattern) of the public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, text: str = "text", path: str | None = None,
           pattern: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian unsigned 32-bit) and
    ``n_tokens`` (long). A narrow map: no shuffle, memory bounded by a slice."""
    where, split = (path, pattern) if path and pattern else default_vocabulary()

    def compute(part):
        c = codec(where, split)
        packed = [c.encode_packed(t) if t else b"" for t in part.column(text).to_pylist()]
        return [pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64())]

    return with_made(docs, text, [T.StructField("ids", T.BinaryType()),
                                      T.StructField("n_tokens", T.LongType())], compute,
                     done=codec.cache_clear)


def decode(encoded: DataFrame, ids: str = "ids", path: str | None = None,
           pattern: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded`` (binary: the bytes of the ids; null ids: empty)."""
    where, split = (path, pattern) if path and pattern else default_vocabulary()

    def compute(part):
        c = codec(where, split)
        return [pa.array([c.decode_packed(p or b"") for p in part.column(ids).to_pylist()], pa.binary())]

    return with_made(encoded, ids, [T.StructField("decoded", T.BinaryType())], compute,
                     done=codec.cache_clear)


def sha256_hex(column: str):
    return F.sha2(F.col(column), 256)


def encode_decode(docs: DataFrame, text: str = "text", path: str | None = None,
                  pattern: str | None = None) -> DataFrame:
    """``docs`` without the text, with ``ids``, ``n_tokens`` and ``decoded`` as
    of ``encode`` and ``decode``, in one map: a task has one codec."""
    where, split = (path, pattern) if path and pattern else default_vocabulary()
    made = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.BinaryType())]
    source, = fresh(docs, "__text")
    kept = [f for f in docs.schema.fields if f.name != text and f.name.lower() not in {m.name for m in made}]
    names = [f.name for f in kept]

    def run(batches):
        for part in slices(batches, source):
            c = codec(where, split)
            packed = [c.encode_packed(t) if t else b"" for t in part.column(source).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(n) for n in names], pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64()),
                 pa.array([c.decode_packed(p) for p in packed], pa.binary())], [*names, "ids", "n_tokens", "decoded"])
        codec.cache_clear()
        release()

    prepare(docs.sparkSession)
    return docs.select(*names, F.col(text).alias(source)).mapInArrow(run, T.StructType([*kept, *made]))


def bpe_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes."""
    return encode_decode(docs.select("doc_id", "text")).select(
        "doc_id", "n_tokens", sha256_hex("ids").alias("ids_sha256"), sha256_hex("decoded").alias("decoded_sha256"))


def op8_byte_bpe(spark, sf_dir):
    return bpe_digests(read_table(spark, sf_dir, "documents"))

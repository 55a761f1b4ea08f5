"""Byte-level BPE: encoding with offsets, decoding, and word-cached bulk encoding.

The tokenizers library produces every id. Byte-level BPE treats each match of
the pre-tokenization pattern by itself, so the ids of a text are the ids of its
matches in order; workers keep a bounded table of matches already encoded.
Offsets and decoding use the byte-to-character table of byte-level vocabularies.
"""

from __future__ import annotations

import base64
import re
import struct
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Matches of a text are looked up in a table of at most so many entries a worker.
CACHE_WORDS = 200_000
#: Longer matches are encoded anew each time.
CACHE_CHARS = 64
#: Below this code point, classes of the fast pattern are spelled out.
PLAIN_LIMIT = 0x250


def byte_chars() -> list[str]:
    """Character of each byte: itself if printable in Latin-1, else the next free one from U+0100."""
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


BYTE_CHARS = byte_chars()
CHAR_BYTES = {c: b for b, c in enumerate(BYTE_CHARS)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def from_ranks(ranks: dict[bytes, int]):
    """A tokenizers object that merges as rank order does.

    Each token of two bytes or more contributes every split into two known
    tokens, in rank order; a match that is a token itself stays whole.
    """
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers

    name = {t: "".join(BYTE_CHARS[b] for b in t) for t in ranks}
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        for i in range(1, len(token)):
            if token[:i] in ranks and token[i:] in ranks:
                merges.append((name[token[:i]], name[token[i:]]))
    tok = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    tok.decoder = decoders.ByteLevel()
    return tok


def load_tokenizer(path: str):
    """``.json``: a tokenizers file; ``.tiktoken``: ranks. Special tokens' strings in a text are ordinary text."""
    from tokenizers import Tokenizer

    tok = from_ranks(read_ranks(path)) if path.endswith(".tiktoken") else Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return tok


def plain_pattern() -> tuple[re.Pattern, re.Pattern]:
    """The byte-level pre-tokenization pattern for text below PLAIN_LIMIT, and a search for anything else."""
    low = [(chr(c), unicodedata.category(chr(c))[0]) for c in range(PLAIN_LIMIT)]
    letter = "".join(re.escape(c) for c, k in low if k == "L")
    number = "".join(re.escape(c) for c, k in low if k == "N")
    space = "\t-\r \x85\xa0"
    pattern = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    return re.compile(pattern), re.compile(f"[^\x00-{chr(PLAIN_LIMIT - 1)}]")


#: Latin-1 character of a byte -> the byte's own character.
LATIN_TO_BYTE_CHARS = str.maketrans(dict(enumerate(BYTE_CHARS)))


class _Words(dict):
    """Match -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, tok):
        self.model = tok.model

    def __missing__(self, word: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(LATIN_TO_BYTE_CHARS))]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = out
        return out


class BulkEncoder:
    """Texts to id bytes. Texts with characters from PLAIN_LIMIT on go through the library whole."""

    _open: dict[str, "BulkEncoder"] = {}

    def __init__(self, path: str):
        self.tok = load_tokenizer(path)
        self.words = _Words(self.tok)
        self.plain, self.other = plain_pattern()
        self.pieces: list[bytes] | None = None

    @classmethod
    def get(cls, path: str) -> "BulkEncoder":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not text.isascii() and self.other.search(text):
            ids = self.tok.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.words.__getitem__, self.plain.findall(text)))

    def table(self) -> list[bytes]:
        """Bytes of each id."""
        if self.pieces is None:
            vocab = self.tok.get_vocab(with_added_tokens=True)
            self.pieces = [b""] * (max(vocab.values()) + 1)
            for token, i in vocab.items():
                known = all(c in CHAR_BYTES for c in token)
                self.pieces[i] = bytes(CHAR_BYTES[c] for c in token) if known else token.encode()
        return self.pieces

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table().__getitem__, memoryview(ids).cast("I")))

    def offsets(self, text: str | None, ids: bytes) -> list[tuple[int, int]]:
        """Character span of each id: from the character that holds its first byte through the one that holds its last."""
        if not text:
            return []
        pieces, at, owner, spans = self.table(), 0, [], []
        for k, c in enumerate(text):
            owner += [k] * len(c.encode())
        for i in memoryview(ids).cast("I"):
            n = len(pieces[i])
            spans.append((owner[at], owner[at + n - 1] + 1))
            at += n
        return spans


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", offsets_col: str | None = None) -> DataFrame:
    """Append ``ids_col`` array<int>, and ``offsets_col`` array<struct<start,end>> in characters if named.

    Null text counts as empty: no ids. Columns of these names in ``df`` are replaced.
    """
    keep = [c for c in df.columns if c not in (ids_col, offsets_col)]
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    fields = [df.schema[c] for c in keep] + [T.StructField(ids_col, T.ArrayType(T.IntegerType()))]
    fields += [T.StructField(offsets_col, T.ArrayType(span))] if offsets_col else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = BulkEncoder.get(path)
        for b in batches:
            texts = b.column(keep.index(text_col)).to_pylist()
            coded = [enc.encode(t) for t in texts]
            cols = [*b.columns, pa.array([memoryview(x).cast("I").tolist() for x in coded], pa.list_(pa.int32()))]
            if offsets_col:
                spans = [[{"start": s, "end": e} for s, e in enc.offsets(t, x)] for t, x in zip(texts, coded, strict=True)]
                cols.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return df.select(*keep).mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded", text_col: str | None = None) -> DataFrame:
    """Append the ids' bytes, and their text if ``text_col`` is named: a character whose bytes are cut off becomes U+FFFD.

    Null ids give empty bytes; unknown ids raise.
    """
    keep = [c for c in df.columns if c not in (bytes_col, text_col)]
    fields = [df.schema[c] for c in keep] + [T.StructField(bytes_col, T.BinaryType())]
    fields += [T.StructField(text_col, T.StringType())] if text_col else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = BulkEncoder.get(path)
        for b in batches:
            out = [b"".join(enc.table()[i] for i in ids or ()) for ids in b.column(keep.index(ids_col)).to_pylist()]
            cols = [*b.columns, pa.array(out, pa.binary())]
            if text_col:
                cols.append(pa.array([x.decode("utf-8", "replace") for x in out], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return df.select(*keep).mapInArrow(run, T.StructType(fields))


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text in one pass over the batch; digests of both sides.

    Returns id_col, n_tokens, ids_sha256, decoded_sha256. Null text: empty. One
    row for each input row, repeated ids included; other columns are ignored.
    """
    import hashlib

    schema = T.StructType([df.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = BulkEncoder.get(path)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1):
                ids = enc.encode(t.as_py())
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)

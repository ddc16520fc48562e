"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

A rolling (gear) hash over the bytes of a text picks chunk ends, so texts that share a passage share its chunks
wherever the passage stands. A worker encodes a chunk once and keeps it, under a bound in bytes, for all documents
that its tasks see. An encoding of a chunk alone can be wrong only near the chunk's ends; so a chunk is kept as a
head, the ids of its middle, and a tail. At each chunk join the tail on the left and the head on the right are
encoded again as one window. A window grows, over whole chunks if need be, until both of its ends agree with token
ends of both sides whatever stands beyond them: before white space that follows a character which is not white
space, where no pattern of the pre-tokenizer can match across. The ids are exactly those of encoding the text whole.

Nulls are encoded as empty texts, and an empty text has no ids; a null id stays null. Very long texts are encoded whole.
Repeated rows give repeated rows, and nothing is ranked, so there are no ties. An empty table gives no rows; further
columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_state

_CUT = re.compile(r"(?<=\S)(?=[ \t\n\r\x0b\x0c])")
_FIRST_CUT = re.compile(r"\S[ \t\n\r\x0b\x0c]")
_SPACE_AFTER_SPACE = re.compile(r"\s ")
#: Beyond these code points, and for long segments, the tokenizers library itself encodes.
_OTHER_SCRIPT = re.compile(r"[^\x00-ɏ]")
_LONG_SEGMENT = 1000
_CACHED_SEGMENT = 48


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_ins = dict(zip(map(chr, plain), plain, strict=True))
    for n, byte in enumerate(b for b in range(256) if b not in set(plain)):
        stand_ins[chr(256 + n)] = byte
    return stand_ins


class ByteBpe:
    """Encodes and decodes as a byte-level BPE tokenizer file says; ids are little-endian uint32 in bytes."""

    def __init__(self, path: str, cached_segments: int = 200_000):
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self._library = path, None
        self.specials = [t["content"] for t in spec["added_tokens"]]
        alphabet = _byte_alphabet()
        vocab = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.specials}
        self.token_bytes: list[bytes] = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.token_bytes[i] = token
        for t in spec["added_tokens"]:
            self.token_bytes[t["id"]] = t["content"].encode()
        self.token_lengths = np.array([len(t) for t in self.token_bytes])
        self.ranked = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab, special_tokens={})
        self.cached_segments = cached_segments
        self._spaced: dict[str, bytes] = {}  # key w stands for the segment " " + w

    @property
    def library(self):
        """The tokenizers library's own encoder, read when it is first needed."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_padding()
            self._library.no_truncation()
        return self._library

    def _library_ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _is_plain(self, text: str) -> bool:
        return len(text) <= _LONG_SEGMENT and (text.isascii() or not _OTHER_SCRIPT.search(text)) and not any(s in text for s in self.specials)

    def _segment(self, text: str) -> bytes:
        if not text:
            return b""
        if self._is_plain(text):
            return np.array(self.ranked.encode_ordinary(text), dtype="<u4").tobytes()
        return self._library_ids(text)

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Encodes the segments " " + w. Those that end in no white space are encoded in one call: each join is a cut."""
        out: dict[str, bytes] = {}
        joined = " " + " ".join(words)
        if max(map(len, words)) > _LONG_SEGMENT or _OTHER_SCRIPT.search(joined) or any(s in joined for s in self.specials):
            plain = [w for w in words if self._is_plain(w)]
        else:
            plain = words
        plain = [w for w in plain if w and not w[-1].isspace()]
        if len(plain) < len(words):
            out = {w: self._segment(" " + w) for w in set(words).difference(plain)}
        if plain:
            joined = " " + " ".join(plain)
            ids = np.array(self.ranked.encode_ordinary(joined), dtype="<u4")
            sizes = map(len, plain) if joined.isascii() else [len(w.encode()) for w in plain]
            ends = np.cumsum(np.fromiter(sizes, np.int64, len(plain)) + 1)
            at = (4 * np.searchsorted(np.cumsum(self.token_lengths[ids]), ends) + 4).tolist()
            packed = ids.tobytes()
            out.update(zip(plain, [packed[i:j] for i, j in zip([0, *at], at)]))
        if len(self._spaced) > self.cached_segments:
            self._spaced.clear()
        self._spaced.update(out if max(map(len, words)) <= _CACHED_SEGMENT else {w: ids for w, ids in out.items() if len(w) <= _CACHED_SEGMENT})
        return out

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` encoded on its own."""
        if not text:
            return b""
        if _SPACE_AFTER_SPACE.search(text):
            parts = _CUT.split(text)
            return b"".join([self._one(p) for p in parts])
        first, *words = text.split(" ")
        found = list(map(self._spaced.get, words))
        if None in found:
            new = self._learn(list({w for w, ids in zip(words, found, strict=True) if ids is None}))
            found = [new[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
        return self._segment(first) + b"".join(found)

    def _one(self, segment: str) -> bytes:
        if segment[:1] == " ":
            w = segment[1:]
            return self._spaced.get(w) or self._learn([w])[w]
        return self._segment(segment)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


_GEAR = np.random.default_rng(20).integers(0, 2**32, 256, dtype=np.uint32)


def chunk_ends(data: bytes, mean_bits: int = 10, least: int = 256, most: int = 16_384, block: int = 1 << 20) -> list[int]:
    """Ends of content-defined chunks of UTF-8 ``data``; each lies between characters."""
    marks = []
    for at in range(0, len(data), block):
        from_ = max(0, at - 31)
        h = _GEAR[np.frombuffer(data, np.uint8, min(len(data), at + block) - from_, from_)]
        for shift in (1, 2, 4, 8, 16):  # the sum over the last 32 bytes, each shifted by its age
            wider = h.copy()
            wider[shift:] += h[:-shift] << np.uint32(shift)
            h = wider
        marks += (np.flatnonzero(h[at - from_ :] >> np.uint32(32 - mean_bits) == 0) + at + 1).tolist()
    marks.append(len(data))
    ends, start = [], 0
    for mark in marks:
        while mark - start > most:
            start = _between_characters(data, start + most)
            ends.append(start)
        if mark - start >= least or mark == len(data) > start:
            start = _between_characters(data, mark)
            ends.append(start)
    return ends


def _between_characters(data: bytes, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


class ChunkedEncoder:
    """Encodes texts by way of shared chunks; ``reused`` and ``encoded`` count chunks."""

    def __init__(self, bpe: ByteBpe, cache_mb: int = 32, **chunking):
        self.bpe, self.chunking = bpe, chunking
        self.most, self.held = cache_mb << 20, 0
        self.chunks: dict[bytes, tuple[str, bytes, str] | None] = {}
        self.reused = self.encoded = 0

    def _chunk(self, data: bytes) -> tuple[str, bytes, str] | None:
        """Head, ids of the middle, and tail; None if the chunk has no cut."""
        key = blake2b(data, digest_size=16).digest()
        if key in self.chunks:
            self.reused += 1
            return self.chunks[key]
        self.encoded += 1
        text, got = data.decode(), None
        if m := _FIRST_CUT.search(text):
            first = m.start() + 1
            last = max(text.rfind(c) for c in " \n\t\r\x0b\x0c")
            while last > first and text[last - 1].isspace():
                last -= 1
            last = max(first, last)
            got = text[:first], self.bpe.encode(text[first:last]), text[last:]
        if self.held > self.most:
            self.chunks.clear()
            self.held = 0
        self.chunks[key] = got
        self.held += 250 + len(data) // 4 + (len(got[1]) if got else 0)
        return got

    def encode(self, text: str) -> bytes:
        data, out, window, start = text.encode(), [], "", 0
        for end in chunk_ends(data, **self.chunking):
            chunk = data[start:end]
            start = end
            if (got := self._chunk(chunk)) is None:  # no agreement inside this chunk: the window grows over it
                window += chunk.decode()
                continue
            head, middle, tail = got
            out += [self.bpe.encode(window + head), middle]
            window = tail
        out.append(self.bpe.encode(window))
        return b"".join(out)


def worker_encoder(path: str) -> ChunkedEncoder:
    """This Python worker's encoder; its caches last over tasks."""
    return worker_state(("bpe", path), lambda: ChunkedEncoder(ByteBpe(path)))


def batches(rows: Iterator[tuple], schema: pa.Schema, most_rows: int = 2000, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows, bounded in rows and in bytes of their texts and binaries."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if len(held) >= most_rows or size >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def encode_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids binary): the ids of each whole text as little-endian unsigned 32-bit integers."""
    schema = pa.schema([("id", pa.int64()), ("ids", pa.binary())])

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        yield from batches(((i, encoder.encode(t or "")) for b in parts for i, t in zip(b[0].to_pylist(), map(_text, b[1]), strict=True)), schema)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(encode, "id long, ids binary")


def _text(value: pa.Scalar) -> str | None:
    return value.as_py()


def decode_documents(df: DataFrame, tokenizer: str) -> DataFrame:
    """Adds the decoded text to rows (id, ids), special tokens kept."""
    schema = pa.schema([("id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def decode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_encoder(tokenizer).bpe
        yield from batches(((i, ids.as_py(), bpe.decode(ids.as_py() or b"")) for b in parts for i, ids in zip(b[0].to_pylist(), b[1], strict=True)), schema)

    return df.select("id", "ids").mapInArrow(decode, "id long, ids binary, decoded string")

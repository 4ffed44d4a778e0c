"""Byte-level BPE: encoding with the tokenizers library over Arrow batches, and decoding.

A piece of text that starts at a single space between two other characters is always split off by
the pre-tokenizer too, whatever stands around it. So each distinct piece is encoded once and kept
in a bounded cache, and a text's ids are those of its pieces in order."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import by_slice

#: Single spaces that have a non-space character on either side.
_JOINTS = re.compile(r"(?<=\S) (?=\S)")
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
_MARKS = "[!-&(-/:-@\\[-`{-~]*"  # ASCII, no apostrophe
#: Pieces whose parts are plain: letters, then marks; perhaps a line's end and the same once more.
_WORD = re.compile(f"({_LETTERS})({_MARKS})(?:(\n)({_LETTERS})({_MARKS}))?")
#: What a worker keeps: pieces, and the parts of them that the pre-tokenizer leaves whole.
CACHED_PIECES = 500_000
CACHED_PARTS = 1_000_000
#: Longer pieces are encoded but not kept.
CACHED_CHARS = 64


def byte_chars() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for
    themselves, the rest by counting on from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _from_ranks(path: str, pattern: str):
    """A tokenizer with the merges that a table of ranks stands for: any two tokens whose bytes
    together are a token, in the order of that token's rank."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    chars = byte_chars()
    shown = {t: "".join(map(chars.__getitem__, t)) for t in ranks}
    merges = [
        (shown[t[:i]], shown[t[i:]])
        for t in sorted(ranks, key=ranks.__getitem__)
        for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
    ]
    made = Tokenizer(models.BPE(
        vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True,
        cache_capacity=0,
    ))
    made.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    return made


class Cache(dict):
    """Ids by piece, made when first asked for; emptied between slices once it is full.

    Ids are kept as their bytes (unsigned, 32 bits): a text's ids are then one join of these, and
    no object is touched for each id."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        ids = self.make(piece)
        if len(piece) <= CACHED_CHARS:
            self[piece] = ids
        return ids


def _as_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _pieces(text: str) -> list[str]:
    """The text, parted at joints; the spaces there are left out."""
    pieces = text.split(" ")
    if all(pieces) and list(map(str.strip, pieces)) == pieces:
        return pieces  # no two space characters stand together: each space is a joint
    return _JOINTS.split(text)


class Codec:
    """Encodes and decodes with one vocabulary; lives in a worker.

    Where a text holds the string of an added token of the vocabulary file (an end mark, say), it gets
    that token's id, as the library's `encode(text, add_special_tokens=False)` gives it; a table of
    ranks has no such tokens."""

    def __init__(self, path: str, pattern: str | None):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".json"):
            self.tokenizer = Tokenizer.from_file(path)
        else:
            self.tokenizer = _from_ranks(path, pattern)
        back = {c: b for b, c in enumerate(byte_chars())}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(map(back.__getitem__, token)) if set(token) <= back.keys() else (
                token.encode()
            )
        self.chars = dict(enumerate(byte_chars()))
        self.merge = self.tokenizer.model.tokenize
        self.pieces, self.parts = Cache(self._spaced), Cache(self._merged)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned integers of 32 bits."""
        for cache, most in ((self.pieces, CACHED_PIECES), (self.parts, CACHED_PARTS)):
            if len(cache) > most:
                cache.clear()
        return [np.frombuffer(self._text(t), "<u4") for t in texts]

    def _text(self, text: str) -> bytes:
        for token in self.added:  # such a token is cut out of the text before anything else
            if token in text:
                return _as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        first, *rest = _pieces(text)
        return self._piece(first, "") + b"".join(map(self.pieces.__getitem__, rest))

    def _spaced(self, piece: str) -> bytes:
        """Ids of a piece with a space before it."""
        return self._piece(piece, " ")

    def _piece(self, piece: str, before: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            return self.parts[before + piece]
        m = _WORD.fullmatch(piece)
        if not m:
            made = self.tokenizer.encode_batch_fast([before + piece], add_special_tokens=False)
            return _as_bytes(made[0].ids)
        first, *rest = m.groups("")
        part = self.parts
        return part[before + first] + b"".join([part[x] for x in rest if x])

    def _merged(self, token: str) -> bytes:
        """Ids of a string that the pre-tokenizer leaves whole."""
        if token.isascii() and token != "\n":  # of these only the space is shown as another character
            shown = token.replace(" ", self.chars[0x20])
        else:
            shown = token.encode().decode("latin-1").translate(self.chars)
        return _as_bytes([t.id for t in self.merge(shown)])

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of the tokens; a character may be split between two of them."""
        return b"".join(map(self.bytes.__getitem__, ids))

    def spans(self, ids: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
        """First and end character of each token; tokens that share a character overlap in it."""
        lengths = np.fromiter((len(self.bytes[i]) for i in ids), np.int64, len(ids))
        ends = np.cumsum(lengths)
        starts_char = (np.frombuffer(self.decode(ids), np.uint8) & 0xC0) != 0x80
        char = np.cumsum(starts_char) - 1  # of each byte
        return char[ends - lengths], char[ends - 1] + 1


@lru_cache(maxsize=2)
def codec(path: str, pattern: str | None = None) -> Codec:
    return Codec(path, pattern)


def texts_of(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def encode(
    docs: DataFrame, path: str, pattern: str | None = None, text: str = "text",
    keep: list[str] | None = None, offsets: bool = True, decoded: bool = False,
) -> DataFrame:
    """Columns `keep` (default: all but those named as below), then `ids`, `starts` and `ends`.

    starts and ends are characters of the text; they are left out without `offsets`. Null and empty texts have no ids. Rows are not moved or dropped, repeated ones are encoded
    each. An input column named ids, starts or ends gives way to the result.

    `decoded`: the ids are decoded again by the same codec; bytes other than the text's are an error,
    and column `decoded_sha256` is their digest."""
    made = ["ids", "starts", "ends"][: 3 if offsets else 1]
    digest = ["decoded_sha256"] if decoded else []
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made + digest]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([
        *(f"`{c}` {kinds[c]}" for c in keep), *(f"{c} array<int>" for c in made), *(f"{c} string" for c in digest),
    ])

    def job(piece: pa.RecordBatch) -> dict:
        held = codec(path, pattern)
        texts = texts_of(piece.column("__text"))
        ids = [i.tolist() for i in held.encode(texts)]
        out = {c: piece.column(c) for c in keep} | {"ids": ids}
        if offsets:
            spans = [held.spans(i) for i in ids]
            out |= {"starts": [s for s, _ in spans], "ends": [e for _, e in spans]}
        if decoded:
            out["decoded_sha256"] = [_read_back(held, i, t) for i, t in zip(ids, texts, strict=True)]
        return out

    return by_slice(docs, [*(f"`{c}`" for c in keep), F.col(text).alias("__text")], schema, job)


def _read_back(held: Codec, ids: list[int], text: str) -> str:
    """Digest of the bytes of the ids, which must be the text's."""
    made = held.decode(ids)
    if made != text.encode():
        raise ValueError(f"{len(ids)} ids decode to other bytes than those of their text")
    return hashlib.sha256(made).hexdigest()


def decode(rows: DataFrame, path: str, pattern: str | None = None, ids: str = "ids") -> DataFrame:
    """All columns and `bytes`, `decoded`: the tokens' bytes, and these as text.

    Null ids give null; a sequence that begins or ends inside a character gives U+FFFD there."""
    keep = [c for c in rows.columns if c not in ("bytes", "decoded")]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", bytes binary, decoded string"

    def job(piece: pa.RecordBatch) -> dict:
        held = codec(path, pattern)
        made = [None if i is None else held.decode(i) for i in piece.column(ids).to_pylist()]
        return {c: piece.column(c) for c in keep} | {
            "bytes": made,
            "decoded": [None if b is None else b.decode("utf-8", "replace") for b in made],
        }

    return by_slice(rows, [f"`{c}`" for c in keep], schema, job)


def digests(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, then decoded again from the ids.

    The same codec as `encode` and `decode`, without carrying the ids out of the worker."""

    def job(piece: pa.RecordBatch) -> dict:
        held = codec(path, pattern)
        encoded = [i.tolist() for i in held.encode(texts_of(piece.column("text")))]
        return {
            "doc_id": piece.column("doc_id"),
            "n_tokens": [len(i) for i in encoded],
            "ids_sha256": [hashlib.sha256(",".join(map(str, i)).encode()).hexdigest() for i in encoded],
            "decoded_sha256": [hashlib.sha256(held.decode(i)).hexdigest() for i in encoded],
        }

    return by_slice(
        docs, ["doc_id", "text"],
        "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", job,
    )

"""Problem 7: token ids of a whole corpus by a public byte-pair vocabulary.

A pair of bytes that stands inside no token of the vocabulary can never be merged over: between them is
a certain cut. Every text is cut at all of its certain cuts, whatever its length; the fragments, most of
them words, are encoded independently, each distinct one once for a task while it stays in the memo, and concatenated.

A cut must also leave the vocabulary's word pattern alone. It does where the character before it is no
white space (white space looks ahead) and the one behind it is no apostrophe (an apostrophe that opens
a fragment could become a contraction).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fragments whose ids a task keeps; then it begins anew.
MEMO = 500_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(path: str):
    """(encoding, 65,536 flags of byte pairs that stand inside a token) of a rank file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    inside = np.zeros(1 << 16, dtype=bool)
    joined = np.frombuffer(b"".join(ranks), dtype=np.uint8).astype(np.int64)
    ends = np.cumsum([len(t) for t in ranks])
    pairs = (joined[:-1] << 8) | joined[1:]
    keep = np.ones(len(pairs), dtype=bool)
    keep[ends[:-1] - 1] = False
    inside[pairs[keep]] = True
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), inside


_NONE = np.zeros(1, dtype=np.uint8)


def _white_ends(data: np.ndarray) -> np.ndarray:
    """Flags of the bytes at which a white space of UTF-8 text ends."""
    one = np.concatenate([_NONE, data[:-1]])
    two = np.concatenate([_NONE, one[:-1]])
    ascii_ = ((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 32))
    latin = (one == 0xC2) & ((data == 0x85) | (data == 0xA0))
    ogham = (two == 0xE1) & (one == 0x9A) & (data == 0x80)
    general = (two == 0xE2) & (one == 0x80) & (((data >= 0x80) & (data <= 0x8A)) | (data == 0xA8) | (data == 0xA9) | (data == 0xAF))
    others = ((two == 0xE2) & (one == 0x81) & (data == 0x9F)) | ((two == 0xE3) & (one == 0x80) & (data == 0x80))
    return ascii_ | latin | ogham | general | others


def cut(raw: bytes, inside: np.ndarray) -> list[bytes]:
    """Fragments of a UTF-8 text between all of its certain cuts."""
    if len(raw) < 2:
        return [raw] if raw else []
    data = np.frombuffer(raw, dtype=np.uint8)
    a, b = data[:-1], data[1:]
    certain = ~inside[(a.astype(np.uint16) << 8) | b] & ((b & 0xC0) != 0x80) & (b != 0x27) & ~_white_ends(data)[:-1]
    places = [0, *(np.flatnonzero(certain) + 1).tolist(), len(raw)]
    return [raw[s:e] for s, e in zip(places, places[1:])]


def encode_text(text: str | None, path: str, memo: dict[bytes, list[int]] | None = None) -> list[int]:
    """Ids of a text; memo keeps those of fragments seen before."""
    if not text:
        return []
    encoding, inside = load(path)
    memo = {} if memo is None else memo
    out: list[int] = []
    for part in cut(text.encode("utf-8"), inside):
        ids = memo.get(part)
        if ids is None:
            if len(memo) >= MEMO:
                memo.clear()
            ids = encoding.encode_ordinary(part.decode("utf-8"))
            if len(part) <= 64:
                memo[part] = ids
        out += ids
    return out


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def encode_corpus(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row: the ids of its text, an empty list for an empty and for a null text.

    Strings of special tokens are ordinary text. One row comes out for each row that goes in, with its doc_id, null or repeated ones too.
    """
    place = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, list[int]] = {}
        for b in batches:
            values: list[int] = []
            ends = [0]
            for text in b.column(1).to_pylist():
                values += encode_text(text, place, memo)
                ends.append(len(values))
            ids = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(values, type=pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), ids], schema=_SCHEMA)

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")

"""Byte-level BPE with public rank files: encoding of whole texts and decoding to raw bytes.

Texts are cut at safe boundaries: between a character that is no white space and a blank, tab or line break.
No alternative of the split pattern matches across such a place, and its one look-ahead looks past white space only,
so the pieces' ids, one after the other, are the ids of the whole text. A cut after a character that some regex
engines count as white space and others don't is never made.

Nulls and empty texts have no ids, and an empty table gives no rows. Special tokens' strings are ordinary text. Extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from .common import lean

#: Texts of more characters are encoded piece by piece.
LONG_TEXT = 20_000

#: Characters that some engines take for white space, besides blank, tab and line breaks.
_ODD_SPACE = "\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The same characters, as a class of any regex engine.
ODD_RE2 = f"[{_ODD_SPACE}]"
_SAFE = re.compile(f"(?<=[^ \t\n\r{_ODD_SPACE}])(?=[ \t\n\r])")
SPACE = re.compile(f"[ \t\n\r{_ODD_SPACE}]")


def pieces(text: str, size: int = LONG_TEXT) -> Iterator[str]:
    """The text cut at safe boundaries into pieces of about `size` characters; a piece without such a boundary stays whole."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class Ranks:
    """A rank file of the tiktoken library: encoder and raw-byte decoder."""

    def __init__(self, path: str | None = None, pattern: str = public_tokenizers.PATTERN):
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    _held: dict[str | None, Ranks] = {}

    @classmethod
    def shared(cls, path: str | None = None) -> Ranks:
        """One for all tasks of a worker process."""
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= LONG_TEXT:
            return np.array(self.encoder.encode_ordinary(text), "<u4")
        return np.concatenate([np.array(self.encoder.encode_ordinary(x), "<u4") for x in pieces(text)])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def round_trip(docs: DataFrame, ranks_path: str | None = None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """For each row: the kept columns, ids (little-endian unsigned 32-bit, as bytes) and the bytes decoded from them.

    Null or empty text: no ids and no bytes. Rows are neither joined nor compared, so ties and repeated rows stay.
    """

    def run(batches):
        ranks = Ranks.shared(ranks_path)
        for batch in batches:
            kept = [batch.column(c) for c in keep]
            at, ids, raw = [], [], []
            for i, x in enumerate(batch.column(text)):
                v = ranks.encode(x.as_py() or "")
                at.append(i)
                ids.append(v.tobytes())
                raw.append(ranks.decode(v))
                if len(at) == 500 or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in kept), pa.array(ids, pa.binary()), pa.array(raw, pa.binary())], names=[*keep, "ids", "decoded"])
                    at, ids, raw = [], [], []

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(lean(run), f"{kinds}, ids binary, decoded binary")


def round_trip_digests(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of `round_trip`, without moving ids or bytes out of the workers."""

    def run(batches):
        ranks = Ranks.shared(ranks_path)
        for batch in batches:
            n, a, b = [], [], []
            for x in batch.column("text"):
                v = ranks.encode(x.as_py() or "")
                n.append(len(v))
                a.append(hashlib.sha256(v.tobytes()).hexdigest())
                b.append(hashlib.sha256(ranks.decode(v)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

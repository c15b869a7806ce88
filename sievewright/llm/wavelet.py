"""Token ids of a corpus in wavelet-matrix shards.

A shard is one self-contained byte string (layout below) that answers access, count and occurrence lookups without
unpacking the shard. Shards are rows of a Parquet table in the shared folder, so any file system that Spark writes to
holds them, and a task that is run again writes the same shard.

Layout, all little-endian: magic "WVM1", version u32, n_tokens u64, n_docs u64, sigma u32, planes u32; two zstd frames,
each after its length u32: alphabet (u32 ids, most frequent first) and document lengths (u32). Each plane, from the highest
bit, is cut into blocks of SPAN bits (first bit lowest): then come, for each plane and block, the ones before it in its plane
(u32) and at the end of each plane its ones in all; for each plane and block the place of its bytes (u64) and the end; and
the blocks, each a zstd frame or, where that is no shorter, its bytes alone. The ones before blocks serve rank and, searched,
select; a lookup unpacks one block of each plane, and blocks stay unpacked once met.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import integer_ids, lean, stored

MAGIC = b"WVM1"
#: A shard is closed by the document that brings it to this many tokens.
SHARD_TOKENS = 1 << 19
SPAN = 1 << 16
#: A block whose share of ones is this near to a half is stored as it is: there is next to nothing to gain.
EVEN = 0.15
_HEAD = struct.Struct("<4sIQQII")


def build(tokens: np.ndarray, lengths: np.ndarray) -> bytes:
    """The shard of these ids, which belong to documents of these lengths."""
    times = np.bincount(tokens)
    alphabet = np.argsort(-times, kind="stable")[: np.count_nonzero(times)]
    code = np.zeros(len(times), np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
    code[alphabet] = np.arange(len(alphabet))
    now = code[tokens]
    planes = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 0
    pack = zstandard.ZstdCompressor(level=1).compress
    before, blocks = [], []
    for k in range(planes):
        one = (now & now.dtype.type(1 << (planes - 1 - k))) != 0
        bits = np.packbits(one, bitorder="little")
        ones = 0
        for start in range(0, len(bits), SPAN // 8):
            raw = bits[start : start + SPAN // 8]
            before.append(ones)
            ones += int(np.bitwise_count(raw).sum())
            share = (ones - before[-1]) / (8 * len(raw))
            packed = pack(raw.tobytes()) if abs(share - 0.5) > EVEN else raw.tobytes()
            blocks.append(packed if len(packed) < len(raw) else raw.tobytes())
        before.append(ones)
        now = np.concatenate((np.compress(~one, now), np.compress(one, now)))
    out = [_HEAD.pack(MAGIC, 1, len(tokens), len(lengths), len(alphabet), planes)]
    for p in map(pack, (alphabet.astype("<u4").tobytes(), lengths.astype("<u4").tobytes())):
        out += [struct.pack("<I", len(p)), p]
    places = np.cumsum([0, *map(len, blocks)])
    return b"".join([*out, np.array(before, "<u4").tobytes(), places.astype("<u8").tobytes(), *blocks])


class Shard:
    """A shard read back: token access, counts and occurrences, by rank and select on bit planes."""

    def __init__(self, data: bytes):
        magic, version, self.n_tokens, self.n_docs, self.sigma, self.planes = _HEAD.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a wavelet-matrix shard")
        at, parts, self._unpack = _HEAD.size, [], zstandard.ZstdDecompressor().decompress
        for _ in range(2):
            (n,) = struct.unpack_from("<I", data, at)
            parts.append(self._unpack(data[at + 4 : at + 4 + n]))
            at += 4 + n
        self.alphabet, self.lengths = (np.frombuffer(p, "<u4") for p in parts)
        self._blocks = -(-self.n_tokens // SPAN)
        n = self.planes * (self._blocks + 1)
        #: Ones before each block of each plane, and of the whole plane.
        self.before = np.frombuffer(data, "<u4", n, at).reshape(self.planes, -1).astype(np.int64)
        self._places = np.frombuffer(data, "<u8", self.planes * self._blocks + 1, at + 4 * n).astype(np.int64)
        self._data, self._start = data, at + 4 * n + 8 * len(self._places)
        self.zeros = self.n_tokens - self.before[:, -1] if self.planes else np.zeros(0, np.int64)
        self._held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    @cached_property
    def _codes(self) -> dict[int, int]:
        return {int(x): i for i, x in enumerate(self.alphabet)}

    def _block(self, plane: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """The 64-bit words of a block, and the ones before each and in all."""
        if (held := self._held.get((plane, block))) is None:
            a, b = self._places[plane * self._blocks + block : plane * self._blocks + block + 2] + self._start
            size = -(-min(SPAN, self.n_tokens - block * SPAN) // 8)
            raw = self._data[a:b] if b - a == size else self._unpack(self._data[a:b])
            words = np.frombuffer(raw + bytes(-size % 8), "<u8")
            held = self._held[plane, block] = words, np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
        return held

    def rank1(self, plane: int, i: int) -> int:
        """Ones before place i of a plane."""
        block, rest = divmod(i, SPAN)
        n = int(self.before[plane, block])
        if rest:
            words, ones = self._block(plane, block)
            n += int(ones[rest >> 6])
            if rest & 63:
                n += (int(words[rest >> 6]) & ((1 << (rest & 63)) - 1)).bit_count()
        return n

    def select(self, plane: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) such bit of a plane."""
        before = self.before[plane]
        if not bit:
            before = np.minimum(np.arange(len(before)) * SPAN, self.n_tokens) - before
        block = int(np.searchsorted(before, j, "right")) - 1
        words, ones = self._block(plane, block)
        if not bit:
            ones = np.arange(len(ones)) * 64 - ones
        word = int(np.searchsorted(ones, j - before[block], "right")) - 1
        left, value = int(j - before[block] - ones[word]), int(words[word])
        bits = value if bit else ~value & (1 << 64) - 1
        for _ in range(left):
            bits &= bits - 1
        return block * SPAN + word * 64 + (bits & -bits).bit_length() - 1

    def access(self, i: int) -> int:
        """The id at place i."""
        code = 0
        for k in range(self.planes):
            words, _ = self._block(k, i // SPAN)
            bit = int(words[i % SPAN >> 6]) >> (i & 63) & 1
            ones = self.rank1(k, i)
            i = int(self.zeros[k]) + ones if bit else i - ones
            code = code << 1 | bit
        return int(self.alphabet[code])

    def _words(self, plane: int) -> np.ndarray:
        """All words of a plane."""
        parts = [self._block(plane, b)[0] for b in range(self._blocks)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at many places: access to all of them at once, by their ranks on one plane after the other."""
        at, code = np.asarray(places, np.int64), np.zeros(len(places), np.uint32)
        for k in range(self.planes if len(at) else 0):
            words = self._words(k)
            before = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            place, shift = at >> 6, (at & 63).astype(np.uint64)
            word = words[place]
            one = (word >> shift) & np.uint64(1)
            ones = before[place] - np.bitwise_count(word >> shift)
            at = np.where(one.view(np.int64), self.zeros[k] + ones, at - ones)
            code = code << np.uint32(1) | one.astype(np.uint32)
        return self.alphabet[code] if self.sigma else code

    def tokens(self) -> np.ndarray:
        """All ids: select of every zero and one of a plane at once, from the lowest plane up."""
        now = np.zeros(self.n_tokens, np.uint16 if self.sigma <= 1 << 16 else np.uint32)
        for k in reversed(range(self.planes)):
            one = np.unpackbits(self._words(k).view(np.uint8), count=self.n_tokens, bitorder="little").view(bool)
            z, up = int(self.zeros[k]), np.empty_like(now)
            up[np.flatnonzero(~one)] = now[:z]
            up[np.flatnonzero(one)] = now[z:] | now.dtype.type(1 << (self.planes - 1 - k))
            now = up
        return self.alphabet[now] if self.sigma else now.astype("<u4")

    def _range(self, token: int, start: int, end: int) -> tuple[int, int, int]:
        code = self._codes.get(token, -1)
        if code < 0:
            return 0, 0, -1
        for k in range(self.planes):
            a, b = self.rank1(k, start), self.rank1(k, end)
            start, end = (int(self.zeros[k]) + a, int(self.zeros[k]) + b) if code >> (self.planes - 1 - k) & 1 else (start - a, end - b)
        return start, end, code

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often an id stands in [start, end)."""
        a, b, _ = self._range(token, start, self.n_tokens if end is None else end)
        return b - a

    def occurrences(self, token: int) -> list[int]:
        """All places of an id, ascending."""
        a, b, code = self._range(token, 0, self.n_tokens)
        out = []
        for at in range(a, b):
            for k in reversed(range(self.planes)):
                bit = code >> (self.planes - 1 - k) & 1
                at = self.select(k, bit, at - int(self.zeros[k]) if bit else at)
            out.append(at)
        return out


def _byte_letters() -> dict[int, str]:
    """The character for each byte in a byte-level vocabulary: printable ones of Latin-1 stand for themselves, the others for characters from 256 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)}


_BYTES = _byte_letters()


class Encoder:
    """Ids by the tokenizers library. Texts are cut at safe boundaries, and each distinct cut is encoded by the library once while it is remembered.

    Strings of added tokens, such as end-of-text marks, give those tokens' ids, as in the library; texts with one are left to it.
    Boundaries are before a blank that follows no white space, and between a Latin letter and a sign of ASCII other than
    the apostrophe or a line break: no alternative of the split pattern has both.
    """

    LIMIT, LONGEST = 700_000, 64
    MARK = "\x01"
    #: Texts in which a blank follows white space, or with characters that may be white space, or with the mark, are cut elsewhere.
    IRREGULAR = f"[ \t\n\r] |{bpe.ODD_RE2}|\x01"
    LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
    BEFORE_SIGN = rf"([{LETTERS}])([!-&(-/:-@\[-`{{-~\n])"
    _WORD = re.compile(f" ?[{LETTERS}]+")
    _held: dict[str | None, Encoder] = {}

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        #: The library takes these strings out of a text before its split pattern sees the rest.
        self.added = re.compile("|".join(map(re.escape, sorted(added)))) if added else None
        self.irregular_re2 = "|".join([self.IRREGULAR, *(re.sub(r"([^0-9A-Za-z_ ])", r"\\\1", x) for x in sorted(added))])
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def shared(cls, path: str | None = None) -> Encoder:
        """One encoder for all tasks of a worker process, which keeps what it has learnt."""
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def plain(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, by the library alone."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def irregular(self, text: str) -> bytes:
        """Ids of one text: whole if it holds a string of an added token, else cut into pieces that keep the library's memory small."""
        if self.added and self.added.search(text):
            return self.plain([text])[0]
        return b"".join(self.plain(list(bpe.pieces(text))))

    def _learn(self, unknown: list[str]) -> dict[str, bytes]:
        """Ids of cuts. Those of letters are one piece of the split pattern each, so the library's merges are asked directly."""
        whole = self._WORD.fullmatch
        words = [x for x in unknown if whole(x)]
        rest = [x for x in unknown if not whole(x)]
        out = dict(zip(rest, self.plain(rest), strict=True))
        merge, table = self.tokenizer.model.tokenize, _BYTES
        for x in words:
            ids = [t.id for t in merge(x.encode().decode("latin1").translate(table))]
            out[x] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def _known(self, cuts: list[str]) -> list[bytes]:
        """Ids of each cut."""
        got = list(map(self.new.get, cuts))
        if None in got:
            unknown = [x for x, v in zip(cuts, got, strict=True) if v is None]
            learnt = {x: v for x in unknown if (v := self.old.get(x)) is not None}
            learnt |= self._learn([x for x in unknown if x not in learnt])
            got = [learnt[x] if v is None else v for x, v in zip(cuts, got, strict=True)]
            self.new.update((x, v) for x, v in learnt.items() if len(x) <= self.LONGEST)
            if len(self.new) > self.LIMIT:
                self.old, self.new = self.new, {}
        return got

    def _regular(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        marked = pc.replace_substring(pc.replace_substring_regex(texts, self.BEFORE_SIGN, rf"\1{self.MARK}\2"), " ", self.MARK + " ")
        cuts = pc.split_pattern(marked, self.MARK)
        offsets = cuts.offsets.to_numpy().astype(np.int64)
        values = cuts.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
        offsets -= offsets[0]
        coded = values.dictionary_encode()
        known = [*self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), np.array([end], "<u4").tobytes()]
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        start = np.cumsum(size) - size
        code = np.insert(coded.indices.to_numpy(), offsets[1:], len(known) - 1)
        many = size[code]
        place = np.repeat(start[code] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return np.frombuffer(b"".join(known), "<u4")[place], np.add.reduceat(many, offsets[:-1] + np.arange(len(texts)))

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts (null: empty), each with the end id after it, one after the other, and how many each has."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.irregular_re2)
        places = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        even = texts.filter(pc.invert(odd))
        tokens, lengths = self._regular(even, end) if len(even) else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        if not len(places):
            return tokens, lengths
        parts, at = np.split(tokens, np.cumsum(lengths)[:-1]) if len(lengths) else [], 0
        irregular, out = set(places.tolist()), []
        for row in range(len(texts)):
            if row in irregular:
                out.append(np.append(np.frombuffer(self.irregular(texts[row].as_py()), "<u4"), np.uint32(end)))
            else:
                out.append(parts[at])
                at += 1
        return np.concatenate(out), np.array(list(map(len, out)), np.int64)


def write_shards(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, shard_tokens: int = SHARD_TOKENS, partitions: int | None = None) -> DataFrame:
    """Encode whole texts, end each document with `end_id`, and write shards in ascending doc_id order; the stored table is returned.

    Rows: part, shard (order of shards), before (ids before the shard within its part), n_tokens, doc_ids, data (the file).
    A null text is empty, so its document is the end id alone; texts of any length are encoded whole. doc_id has to be of an
    integer type. Rows with equal doc_id all stay, ordered by text; null
    doc_ids come first. A document is never split between shards. An empty table gives no shards.
    """
    spark = docs.sparkSession
    integer_ids(docs)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), Encoder.shared(tokenizer)
        ids, lengths, held, shard, before, size = [], [], [], 0, 0, 0

        def close():
            tokens = np.concatenate(held)
            arrays = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([len(tokens)], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([build(tokens, np.array(lengths, "<u4"))], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["part", "shard", "before", "n_tokens", "doc_ids", "data"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                names, row, spot = some.column("doc_id").to_pylist(), 0, 0
                tokens, counts = encoder.encode(some.column("text"), end_id)
                while row < len(names):
                    take = int(np.searchsorted(np.cumsum(counts[row:]), max(1, shard_tokens - size))) + 1  # the document that fills the shard is its last
                    take = min(take, len(names) - row)
                    n = int(counts[row : row + take].sum())
                    held.append(tokens[spot : spot + n])
                    ids += names[row : row + take]
                    lengths += counts[row : row + take].tolist()
                    row, spot, size = row + take, spot + n, size + n
                    if size >= shard_tokens:
                        yield close()
                        ids, lengths, held, shard, before, size = [], [], [], shard + 1, before + size, 0
        if ids:
            yield close()

    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ranged.mapInArrow(lean(run), "part int, shard int, before long, n_tokens long, doc_ids array<long>, data binary"), "wavelet")


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, read from the shards.

    Ids come from select over whole planes; the first and last of each document are also accessed by rank, and have to agree.
    """
    from pyspark.sql import Window

    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                shard = Shard(one.column("data")[0].as_py())
                ids, ends = shard.tokens(), np.cumsum(shard.lengths, dtype=np.int64)
                starts = ends - shard.lengths
                for places in (starts, ends - 1):
                    if (shard.at(places) != ids[places]).any():
                        raise ValueError("a shard's ranks and its bits disagree")
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[a * 4 : b * 4]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                first = one.column("base")[0].as_py() + one.column("before")[0].as_py()
                yield pa.RecordBatch.from_arrays([one.column("doc_ids").flatten(), pa.array(starts + first, pa.int64()), pa.array(shard.lengths, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.join(F.broadcast(bases), "part").select("base", "before", "doc_ids", "data").mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")

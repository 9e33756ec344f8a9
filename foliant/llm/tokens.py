"""Token ids in directly addressable codes, in the order of the documents' ids.

A file holds the ids of consecutive documents. An id is cut into chunks of `CHUNK_BITS` bits, lowest first; level k
holds the k-th chunk of every id that has one, and a bitmap that tells which of them continue. A rank directory (ones
before each 512-bit block) finds an id's chunk in the next level, so any token is read in as many steps as it has
chunks, without decoding others.

Layout of a file (little-endian): magic "DAC1", uint32 chunk bits, uint32 levels, uint32 documents, uint64 tokens; for
each document int64 id and uint64 tokens before it; then for each level uint64 codes, the codes, and, but for the last
level, the bitmap and the directory (uint32 for each block of 512 bits).

Files are plain files of the shared folder; a table of their names, in order, says which of them count (see store).
Null texts count as empty. Repeated rows and equal ids keep their own entries (their order is by id, then text). Rows
with a null id are dropped, for they have no place in the order. Very long texts are encoded whole; a file ends with the
document that reaches `shard_tokens`. An empty table gives no files and an empty result. Other columns are not read.
"""

from __future__ import annotations

import struct
import sys
import types
import zlib
from collections.abc import Sequence
from itertools import chain
from math import ceil

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import partitions, shared_dir, table, written
from foliant.llm.store import load, save

CHUNK_BITS = 8
_BLOCK_BITS = 512


def pack(levels_ids: np.ndarray, doc_ids: Sequence[int], counts: Sequence[int], bits: int = CHUNK_BITS) -> bytes:
    """A file with the ids of documents, counts[i] of them for doc_ids[i]."""
    values, levels = np.asarray(levels_ids, np.uint32), []
    while True:
        low, high = values & np.uint32((1 << bits) - 1), values >> np.uint32(bits)
        more = high > 0
        levels.append((low.astype(np.uint8 if bits <= 8 else np.uint16), more))
        if not more.any():
            break
        values = high[more]
    counts = np.asarray(counts, np.int64)
    starts = np.cumsum(counts) - counts
    out = [b"DAC1", struct.pack("<IIIQ", bits, len(levels), len(doc_ids), len(levels_ids)), np.stack([np.asarray(doc_ids, "<i8"), starts.astype("<i8")], 1).tobytes()]
    for k, (low, more) in enumerate(levels):
        out += [struct.pack("<Q", len(low)), low.tobytes()]
        if k < len(levels) - 1:
            padded = np.zeros(-(-len(low) // _BLOCK_BITS) * _BLOCK_BITS, bool)
            padded[: len(low)] = more
            ones = padded.reshape(-1, _BLOCK_BITS).sum(1)
            out += [np.packbits(padded, bitorder="little").tobytes(), (np.cumsum(ones) - ones).astype("<u4").tobytes()]
    return b"".join(out)


class Reader:
    """Random access to a file's tokens."""

    def __init__(self, file: bytes | np.ndarray) -> None:
        assert bytes(file[:4]) == b"DAC1", "not a token file"
        self.bits, n_levels, n_docs, self.n = struct.unpack_from("<IIIQ", file, 4)
        docs = np.frombuffer(file, "<i8", 2 * n_docs, 24).reshape(-1, 2)
        self.doc_ids, self.starts = docs[:, 0], np.append(docs[:, 1], self.n)
        at, kind, self.levels = 24 + 16 * n_docs, np.uint8 if self.bits <= 8 else np.uint16, []
        for k in range(n_levels):
            (n,) = struct.unpack_from("<Q", file, at)
            codes = np.frombuffer(file, kind, n, at + 8)
            at += 8 + codes.nbytes
            bitmap = ranks = None
            if k < n_levels - 1:
                blocks = -(-n // _BLOCK_BITS)
                bitmap = np.frombuffer(file, np.uint8, blocks * _BLOCK_BITS // 8, at)
                ranks = np.frombuffer(file, "<u4", blocks, at + bitmap.nbytes)
                at += bitmap.nbytes + ranks.nbytes
            self.levels.append((codes, bitmap, ranks))

    def __getitem__(self, i: int) -> int:
        """The i-th token of the file."""
        value = shift = 0
        for codes, bitmap, ranks in self.levels:
            value |= int(codes[i]) << shift
            shift += self.bits
            if bitmap is None or not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // _BLOCK_BITS
            bits = int.from_bytes(bitmap[block * 64 : block * 64 + 64].tobytes(), "little") & ((1 << (i % _BLOCK_BITS)) - 1)
            i = int(ranks[block]) + bits.bit_count()
        return value

    def tokens(self, a: int, b: int) -> np.ndarray:
        """Tokens a to b (not included), by the same directories, all at once."""
        out, shift, span = np.zeros(b - a, np.uint32), 0, (a, b)
        where = np.arange(b - a)
        for codes, bitmap, ranks in self.levels:
            out[where] |= codes[span[0] : span[1]].astype(np.uint32) << np.uint32(shift)
            shift += self.bits
            if bitmap is None or span[0] == span[1]:
                break
            first = span[0] // 8
            more = np.unpackbits(bitmap[first : -(-span[1] // 8)], bitorder="little")[span[0] - first * 8 :][: span[1] - span[0]].astype(bool)
            where, start = where[more], span[0]
            block = start // _BLOCK_BITS
            bits = int.from_bytes(bitmap[block * 64 : block * 64 + 64].tobytes(), "little") & ((1 << (start % _BLOCK_BITS)) - 1)
            lo = int(ranks[block]) + bits.bit_count() if len(ranks) > block else 0
            span = (lo, lo + len(where))
        return out


class FileReader:
    """Single tokens of a file by ranged reads: the header's few numbers, then one chunk, bit and rank for each level."""

    def __init__(self, read) -> None:
        self.read = read
        self.bits, n_levels, n_docs, self.n = struct.unpack("<IIIQ", read(4, 20))
        self.width, at, self.levels = 1 if self.bits <= 8 else 2, 24 + 16 * n_docs, []
        for k in range(n_levels):
            (n,) = struct.unpack("<Q", read(at, 8))
            codes = at + 8
            bitmap = codes + n * self.width
            ranks = bitmap + -(-n // _BLOCK_BITS) * _BLOCK_BITS // 8
            at = ranks + -(-n // _BLOCK_BITS) * 4
            self.levels.append((codes, *((bitmap, ranks) if k < n_levels - 1 else (None, None))))

    def __getitem__(self, i: int) -> int:
        """The i-th token of the file."""
        value = shift = 0
        for codes, bitmap, ranks in self.levels:
            value |= int.from_bytes(self.read(codes + i * self.width, self.width), "little") << shift
            shift += self.bits
            if bitmap is None:
                break
            block, at = divmod(i, _BLOCK_BITS)
            bits = int.from_bytes(self.read(bitmap + block * _BLOCK_BITS // 8, _BLOCK_BITS // 8), "little")
            if not bits >> at & 1:
                break
            i = int.from_bytes(self.read(ranks + 4 * block, 4), "little") + (bits & ((1 << at) - 1)).bit_count()
        return value


#: What Python counts as white space, as a class of RE2.
_WHITE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_SLICE = 8 << 20
#: Bytes of text for a task, which sorts them.
_TASK = 256 << 20


_MARKS = ".,!?;:"


class _Table:
    """The ids of numbered pieces, one after the other."""

    def __init__(self) -> None:
        self.sizes, self.flat = np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def add(self, sizes: np.ndarray, ids: np.ndarray, base: int = 0) -> range:
        """The numbers of new pieces, from base on."""
        n = base + len(self.sizes)
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, ids])
        return range(n, n + len(sizes))


def _gather(sizes: np.ndarray, ids: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sizes and ids of numbered pieces, one after the other."""
    length = sizes[numbers]
    begin, ends = np.cumsum(sizes, dtype=np.int64) - sizes, np.cumsum(length, dtype=np.int64)
    at = np.repeat((begin[numbers] - ends + length).astype(np.int32), length)  # a slice's ids are far fewer than 2^31
    at += np.arange(len(at), dtype=np.int32)
    return length, ids[at]


class Encoder:
    """Encodes columns of texts with a byte-level BPE of the tokenizers library; keeps the ids of the pieces it met first, up to a bound.

    A single space after a character that is no white space always starts a pre-token, so the pieces of a text between
    such spaces encode one by one; a single line feed is a pre-token of its own and starts a piece likewise. So a column is
    split into pieces and these are numbered by Arrow; pieces not seen before go to the library a hundred in a string,
    whose ids are cut again where a token begins with a space or is a line feed. Marks behind letters are a pre-token of
    their own. Texts with white space in a row, or at their start, are encoded as a whole.
    """

    def __init__(self, path: str, keep: int = 500_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.keep, self.table, self.known = Tokenizer.from_file(path), keep, _Table(), {}
        kinds = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            kinds[i] = token[:1] == "\u0120" or token == "\u010a"
        self.starts = kinds
        self.direct = self.tokenizer.normalizer is None and type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel"

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The sizes and ids of texts, each encoded as a whole."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(map(len, found), np.int32, len(found)), np.fromiter(chain.from_iterable(found), np.uint32)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The sizes and ids of pieces; a hundred in a string unless one of them ends in white space."""
        whole = [p if p[:1] == "\n" else " " + p for p in pieces]
        sizes, ids = self._ids(["".join(whole[a : a + 100]) for a in range(0, len(whole), 100)])
        first = np.flatnonzero(self.starts[ids])
        if len(first) == len(whole) and not any(p[-1].isspace() for p in whole):
            return np.diff(np.append(first, len(ids))).astype(np.int32), ids
        return self._ids(whole)

    def _numbers(self, pieces: list[str], fresh: _Table) -> np.ndarray:
        """A number for each of the pieces, which are distinct: new ones are kept as long as there is room, else in fresh."""
        out = list(map(self.known.get, pieces))
        new = [p for p, k in zip(pieces, out) if k is None]
        if not new:
            return np.array(out, np.int64)
        odd = [p for p in new if not p or p[-1].isspace()]
        new = [p for p in new if p and not p[-1].isspace()] if odd else new
        sizes, ids = (np.concatenate(x) for x in zip(*(self._pieces(x) for x in (new, odd) if x)))
        new += odd
        room = max(0, min(self.keep - len(self.table.sizes), len(new)))
        cut = int(sizes[:room].sum())
        number = dict(zip(new, chain(self.table.add(sizes[:room], ids[:cut]), fresh.add(sizes[room:], ids[cut:], self.keep))))
        self.known.update(zip(new[:room], number.values()))
        return np.array([number[p] if k is None else k for p, k in zip(pieces, out)], np.int64)

    def _table_of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The sizes and ids of distinct pieces. Marks behind letters are a pre-token of their own and are encoded once."""
        stems, fresh = pc.utf8_rtrim(pieces, characters=_MARKS), _Table()
        cut = pc.and_(pc.utf8_is_alpha(stems), pc.less(pc.binary_length(stems), pc.binary_length(pieces)))
        stems = pc.if_else(cut, stems, pieces).dictionary_encode()
        tails = pc.replace_substring_regex(pieces.filter(cut), f"^(?s:.*)[^{_MARKS}]", "").dictionary_encode()
        numbers = self._numbers(stems.dictionary.to_pylist(), fresh)[np.asarray(stems.indices)]
        ends = np.fromiter(fresh.add(*self._ids(["", *tails.dictionary.to_pylist()]), self.keep), np.int64)
        both = np.full((len(pieces), 2), ends[0])
        both[:, 0] = numbers
        both[np.asarray(cut), 1] = ends[1:][np.asarray(tails.indices)]
        sizes, ids = np.concatenate([self.table.sizes, fresh.sizes]), np.concatenate([self.table.flat, fresh.flat])
        both = np.where(both >= self.keep, both - self.keep + len(self.table.sizes), both)
        length, ids = _gather(sizes, ids, both.ravel())
        return length.reshape(-1, 2).sum(1, dtype=np.int32), ids

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, and all ids."""
        plain = np.zeros(len(texts), bool)
        if self.direct and len(texts):
            plain = ~np.asarray(pc.match_substring_regex(texts, f"^{_WHITE}|{_WHITE}{{2}}")) & (np.asarray(pc.binary_length(texts)) > 0)
        some = texts.filter(pa.array(plain))
        split = pc.split_pattern(pc.replace_substring(some, "\n", " \n"), " ")
        first, flat = np.asarray(split.offsets)[: len(some)].astype(np.int64), split.flatten()
        pieces = flat.dictionary_encode()
        sizes, ids = self._table_of(pieces.dictionary)
        n, whole = self._ids([*flat.take(pa.array(first)).to_pylist(), *texts.filter(pa.array(~plain)).to_pylist()])
        own = len(sizes) + np.arange(len(n))  # first pieces of texts, and whole texts
        sizes, ids = np.concatenate([sizes, n]), np.concatenate([ids, whole])
        per_text = np.ones(len(texts), np.int64)
        per_text[plain] = np.diff(np.asarray(split.offsets)) if len(some) else 1
        numbers, last = np.empty(int(per_text.sum()), np.int64), np.cumsum(per_text)
        numbers[np.repeat(plain, per_text)] = np.asarray(pieces.indices)
        numbers[(last - per_text)[plain]], numbers[(last - per_text)[~plain]] = own[: len(some)], own[len(some) :]
        length, out = _gather(sizes, ids, numbers)
        until = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
        return until[last] - until[last - per_text], out

    def __call__(self, text: str) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit integers."""
        return self.column(pa.array([text], pa.string()))[1].astype("<u4").tobytes()


def encoder(path: str) -> Encoder:
    """This worker process's encoder. Functions travel to workers by value and end with their task, so it is kept in a module of its own."""
    kept = sys.modules.setdefault("foliant_kept_encoders", types.ModuleType("foliant_kept_encoders")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def slices(texts: pa.Array, most: int = _SLICE):
    """Bounds of runs of texts of about `most` bytes."""
    size, a = np.cumsum(np.asarray(pc.binary_length(texts), np.int64)), 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def write(docs: DataFrame, path: str, text: str = "text", end_id: int | None = 0, shard_tokens: int = 1 << 20) -> DataFrame:
    """Writes the files; returns their table: part, shard (their order), before (tokens in the part before it), n_tokens, folder,
    name. end_id ends each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    folder = shared_dir(docs.sparkSession)
    names = ["part", "shard", "before", "n_tokens", "folder", "name"]

    def run(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, part, shard, before = encoder(path), TaskContext.get().partitionId(), 0, 0
        docs_, counts, ids, total = [], [], [], 0

        def file(rest: bool = False):
            """Writes files of what is held: each ends with the document that reaches shard_tokens."""
            nonlocal docs_, counts, ids, total, shard, before
            d, n, flat = (np.concatenate(x) for x in (docs_, counts, ids))
            ends, a, lo = np.cumsum(n), 0, 0
            while a < len(d):
                b = int(np.searchsorted(ends, lo + shard_tokens)) + 1
                if b > len(d) and not rest:
                    break
                b = min(b, len(d))
                hi = int(ends[b - 1])
                name = save(folder, f"tokens-{part}-{shard}", [pack(flat[lo:hi], d[a:b], n[a:b])])
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((part, shard, before, hi - lo, folder, name), kinds)], names)
                shard, before, a, lo = shard + 1, before + hi - lo, b, hi
            docs_, counts, ids, total = [d[a:]], [n[a:]], [flat[lo:]], len(flat) - lo

        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for b in batches:
            texts = b.column(1)
            for lo, hi in slices(texts):
                n, flat = encode.column(texts.slice(lo, hi - lo))
                if end_id is not None:
                    closed = np.full(len(flat) + len(n), end_id, np.uint32)
                    closed[np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)] = flat
                    n, flat = n + 1, closed
                docs_.append(np.asarray(b.column(0).slice(lo, hi - lo)))
                counts.append(n)
                ids.append(flat)
                total += len(flat)
                if total >= shard_tokens:
                    yield from file()
        if docs_:
            yield from file(rest=True)

    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(partitions(docs.sparkSession), ceil(size / _TASK))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(run, "part int, shard int, before long, n_tokens long, folder string, name string"))


def read(files: DataFrame) -> DataFrame:
    """Each document of the files: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32."""

    def run(batches):
        for b in batches:
            for before, folder, name in zip(*(c.to_pylist() for c in b.columns)):
                r = Reader(load(folder, name))
                ids, a = r.tokens(0, r.n).astype("<u4"), r.starts
                crc = np.fromiter((zlib.crc32(ids[x:y]) for x, y in zip(a[:-1].tolist(), a[1:].tolist())), np.int64, len(r.doc_ids))
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in (r.doc_ids, before + a[:-1], np.diff(a), crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # Tokens before each part: one number for each range partition, a row for 256 MB of text.
    parts = sorted(tuple(r) for r in files.groupBy("part").agg(F.sum("n_tokens")).collect())
    before, total = [], 0
    for p, n in parts:
        before.append((p, total))
        total += n
    offsets = files.sparkSession.createDataFrame(before, "part int, before_part long")
    placed = files.join(F.broadcast(offsets), "part").select((F.col("before_part") + F.col("before")).alias("before"), "folder", "name")
    # A file's name is a few bytes but its content isn't, so names are dealt evenly before files are read.
    return placed.repartition(partitions(files.sparkSession)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read(write(docs, public_tokenizers.path("byte_bpe_50k.json")))

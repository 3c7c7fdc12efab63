"""Token ids in binary shards of independent zstandard frames (operator 10).

A shard is a run of zstandard frames followed by one skippable frame that holds the seek table. Frames are
independent, so a reader takes the footer, the table and then only the frames of the documents it wants.

    frames     zstandard, each at most FRAME_IDS ids, little-endian, 2 bytes an id (4 for large vocabularies)
    skippable  magic 0x184D2A5E, length; then the table:
               for each frame     u64 offset, u32 compressed bytes, u32 ids, u32 CRC-32 of the compressed bytes
               for each document  i64 doc_id (nulls: the least value), u64 first id in the shard, u64 ids
               footer             u64 table offset, u32 frames, u32 documents, u8 bytes an id, u32 CRC-32 of the table, 4 bytes "RGTS"

A document may run over several frames. A null text is empty and gets the end id alone; rows with equal or
null ids (which come first) are all kept, in the order of a hash of their texts, so that they need not meet in
one task; an empty table gives no files and no rows; extra columns are ignored. Shards are written by the tasks
straight into the shared folder under names of their own, and count only once their row is in the
manifest, so a lost or repeated task leaves at most an unused file.

Ids come from the tokenizers library. Pieces between white space, and between ASCII punctuation and
letters, never influence each other in this tokenizer (see `Encoder`), so each distinct piece is encoded
once and remembered until a task ends; texts holding added tokens are encoded whole.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import flat
from .runtime import mapped, shared_dir, stored, table, tokenizer_file

U = np.uint64
END_ID = 2
FRAME_IDS = 1 << 17
SHARD_IDS = 1 << 26
SKIPPABLE = 0x184D2A5E
FRAME, DOC, FOOTER = struct.Struct("<QIII"), struct.Struct("<qQQ"), struct.Struct("<QIIBI4s")
NO_ID = -(2**63)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Any store that pyarrow knows by its URI; plain paths are local."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return pafs.LocalFileSystem(), path


class ShardWriter:
    """Writes one shard, frame by frame."""

    def __init__(self, path: str, item: int):
        fs, at = filesystem(path)
        self.path, self.dtype = path, np.dtype("<u2" if item == 2 else "<u4")
        self.out = fs.open_output_stream(at, compression=None)
        self.packer = zstandard.ZstdCompressor(level=3)
        self.frames: list[bytes] = []
        self.docs: list[bytes] = []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = self.offset = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(DOC.pack(NO_ID if doc_id is None else doc_id, self.n_ids, len(ids)))
        self.n_ids += len(ids)
        for at in range(0, len(ids), FRAME_IDS):
            self.waiting.append(ids[at : at + FRAME_IDS].astype(self.dtype))
            self.n_waiting += len(self.waiting[-1])
            if self.n_waiting >= FRAME_IDS:
                self.flush()

    def flush(self) -> None:
        if not self.n_waiting:
            return
        raw = np.concatenate(self.waiting).tobytes()
        packed = self.packer.compress(raw)
        self.frames.append(FRAME.pack(self.offset, len(packed), self.n_waiting, zlib.crc32(packed)))
        self.out.write(packed)
        self.offset += len(packed)
        self.waiting, self.n_waiting = [], 0

    def close(self) -> tuple[int, int]:
        self.flush()
        body = b"".join(self.frames) + b"".join(self.docs)
        footer = FOOTER.pack(self.offset + 8, len(self.frames), len(self.docs), self.dtype.itemsize, zlib.crc32(body), b"RGTS")
        self.out.write(struct.pack("<II", SKIPPABLE, len(body) + len(footer)) + body + footer)
        self.out.close()
        return len(self.docs), self.n_ids


class ShardReader:
    """Random access to one shard; every frame's checksum is verified when it is read."""

    def __init__(self, path: str):
        fs, at = filesystem(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        start, n_frames, n_docs, item, crc, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != b"RGTS":
            raise ValueError(f"not a token shard: {path}")
        body = self.file.read_at(size - FOOTER.size - start, start)
        if zlib.crc32(body) != crc:
            raise ValueError(f"seek table is damaged: {path}")
        cut = n_frames * FRAME.size
        self.frames = np.frombuffer(body[:cut], [("at", "<u8"), ("size", "<u4"), ("ids", "<u4"), ("crc", "<u4")])
        self.docs = np.frombuffer(body[cut:], [("doc_id", "<i8"), ("first", "<u8"), ("n", "<u8")])
        assert len(self.docs) == n_docs
        self.first = np.concatenate([[0], np.cumsum(self.frames["ids"].astype(np.int64))])
        self.dtype, self.path = np.dtype("<u2" if item == 2 else "<u4"), path
        self.unpacker = zstandard.ZstdDecompressor()
        self.kept: tuple[int, np.ndarray] | None = None
        self.n_read = 0

    def frame(self, k: int) -> np.ndarray:
        if not self.kept or self.kept[0] != k:
            f = self.frames[k]
            packed = self.file.read_at(int(f["size"]), int(f["at"]))
            if zlib.crc32(packed) != f["crc"]:
                raise ValueError(f"frame {k} is damaged: {self.path}")
            self.kept = k, np.frombuffer(self.unpacker.decompress(packed), self.dtype)
            self.n_read += 1
        return self.kept[1]

    def ids(self, row: int) -> np.ndarray:
        """Ids of the document in this row of the table, from its own frames only."""
        a = int(self.docs["first"][row])
        b = a + int(self.docs["n"][row])
        k, parts = int(np.searchsorted(self.first, a, "right")) - 1, []
        while a < b:
            upto = min(b, int(self.first[k + 1]))
            parts.append(self.frame(k)[a - self.first[k] : upto - self.first[k]])
            a, k = upto, k + 1
        return np.concatenate(parts).astype(np.uint32) if parts else np.zeros(0, np.uint32)


#: byte classes once letters are lower-cased
_LETTER, _OTHER, _WIDE = 1, 2, 3
CLASS = np.full(256, _OTHER, np.uint8)
CLASS[flat.SPACE] = 0
CLASS[97:123] = _LETTER
CLASS[128:] = _WIDE


class Encoder:
    """Encodes byte texts piece by piece, with a memory of pieces.

    The vocabulary lower-cases, composes (NFC) and splits at white space and between letters, single digits
    and other runs; only the contractions join an apostrophe to letters. So a word without apostrophe can be
    cut between an ASCII non-letter and a letter of a-z or U+00C0..U+00FF, whichever comes first: neither
    composition nor a split rule crosses that place. A piece of such letters alone is one unit of the
    tokenizer and ends with an end-of-word id, which lets many be encoded in one call.
    """

    LIMIT, SLOTS = 1 << 18, 1 << 18

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.is_end = np.zeros(self.size, bool)
        self.is_end[[v for k, v in vocab.items() if k.endswith("</w>")]] = True
        self.added = [t.content.lower().encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.reset()

    def reset(self) -> None:
        self.known, self.number = np.zeros(0, U), np.zeros(0, np.int64)  # by hash, ascending
        self.key, self.slot = np.zeros(self.SLOTS, U), np.full(self.SLOTS, -1, np.int64)
        self.pool, self.used = np.zeros(1 << 20, np.int32), 0
        self.start, self.length, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def pieces(self, low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, whether made of single letters' bytes only, and bounds by document."""
        c = CLASS[low]
        lead = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] != 0x97) & (low[1:] != 0xB7)) if len(low) else np.zeros(0, np.int64)
        c[lead] = c[lead + 1] = _LETTER
        starts, ends, bounds = flat.words(low, off, flat.NOT_SPACE)
        quote = np.flatnonzero(low == 39)
        cut = np.zeros(len(low), bool)
        if len(low):
            cut[1:] = (c[1:] != c[:-1]) & (c[1:] + c[:-1] == _LETTER + _OTHER) & (c[1:] != 0) & (c[:-1] != 0)
        if len(quote):
            for w in np.unique(np.searchsorted(starts, quote, "right") - 1):
                cut[starts[w] : ends[w]] = False
        cut[starts] = True
        first = np.flatnonzero(cut)
        inside = c != 0
        first = first[inside[first]]
        word = np.searchsorted(starts, first, "right") - 1
        stop = np.empty(len(first), np.int64)
        if len(first):
            stop[:-1] = np.minimum(first[1:], ends[word[:-1]])
            stop[-1] = ends[word[-1]]
        odd = np.concatenate([[0], np.cumsum(c != _LETTER)])
        return first, stop, odd[stop] == odd[first], np.searchsorted(first, off)

    def learn(self, low: np.ndarray, keys: np.ndarray, starts: np.ndarray, stops: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """Numbers of these distinct pieces (ascending hashes), encoding those not met before."""
        at = np.searchsorted(self.known, keys)
        old = np.zeros(len(keys), bool)
        old[at < len(self.known)] = self.known[at[at < len(self.known)]] == keys[at < len(self.known)]
        out = np.empty(len(keys), np.int64)
        out[old] = self.number[at[old]]
        simple, rest = np.flatnonzero(~old & plain), np.flatnonzero(~old & ~plain)
        groups = [simple[i : i + 256] for i in range(0, len(simple), 256)]
        texts = [joined(low, starts[g], stops[g]) for g in groups]
        for g, e in zip(groups, self.tok.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            x = np.array(e.ids, np.int32)
            ends = np.flatnonzero(self.is_end[x]) + 1
            if len(ends) == len(g):
                out[g] = self.keep(x, np.diff(ends, prepend=0))
            else:  # not one unit each after all
                rest = np.concatenate([rest, g])
        raw = low.tobytes()
        more = self.tok.encode_batch_fast([raw[starts[i] : stops[i]].decode("utf-8", "replace") for i in rest], add_special_tokens=False)
        if more:
            ids = [e.ids for e in more]
            out[rest] = self.keep(np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int64))
        both = np.concatenate([self.known, keys[~old]])
        order = np.argsort(both, kind="stable")
        self.known, self.number = both[order], np.concatenate([self.number, out[~old]])[order]
        return out

    def keep(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Store the ids of some pieces; their numbers."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.n + len(sizes) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        new = np.arange(self.n, self.n + len(sizes))
        self.pool[self.used : self.used + len(ids)] = ids
        self.start[new], self.length[new] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used, self.n = self.used + len(ids), self.n + len(sizes)
        return new

    def encode(self, buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """Ids of each document, without an end id."""
        if self.n > self.LIMIT:
            self.reset()
        low = flat.LOWER[buf]
        first, stop, plain, bounds = self.pieces(low, off)
        h = flat.BYTES.spans(flat.BYTES.prefix(low), first, stop)
        slot = (h & U(self.SLOTS - 1)).astype(np.int64)
        number = np.where(self.key[slot] == h, self.slot[slot], -1)
        miss = np.flatnonzero(number < 0)
        if len(miss):
            u, where, back = np.unique(h[miss], return_index=True, return_inverse=True)
            at = miss[where]
            found = self.learn(low, u, first[at], stop[at], plain[at])
            number[miss] = found[back]
            s = (u & U(self.SLOTS - 1)).astype(np.int64)
            self.key[s], self.slot[s] = u, found
            # of two pieces on one slot the later wins for both arrays alike: indices repeat in order
        n = self.length[number]
        ends = np.cumsum(n)
        flat_ids = self.pool[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(self.start[number], n)]
        edge = np.concatenate([[0], ends])[bounds]
        out = [flat_ids[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
        raw = low.tobytes()
        if any(raw.find(t) >= 0 for t in self.added):
            for d in range(len(out)):
                text = raw[off[d] : off[d + 1]]
                if any(t in text for t in self.added):
                    whole = buf[off[d] : off[d + 1]].tobytes().decode("utf-8", "replace")
                    out[d] = np.array(self.tok.encode(whole, add_special_tokens=False).ids, np.int32)
        return out


def joined(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> str:
    """The spans as one text, a space between each two."""
    n = stops - starts + 1
    ends = np.cumsum(n)
    at = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(starts, n)
    out = buf[np.minimum(at, len(buf) - 1)]
    out[ends - 1] = 32
    return out[:-1].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, *, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write all documents as shards in ascending doc_id order; returns the manifest (stored), one row a shard."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    # the raw texts are dealt out by range, not the ids: sampling for the ranges then costs a scan, not an encoding
    rows = rows.withColumn("mark", F.xxhash64("text")).repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text").drop("mark")
    fs, at = filesystem(folder)
    fs.create_dir(at, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, n, writer = encoder(vocabulary), TaskContext.get().partitionId(), 0, None
        done: list[tuple] = []

        def close() -> None:
            done.append((writer.path, part, n, *writer.close()))

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for a, b, buf, off in flat.chunks(batch.column("text")):
                for d, x in zip(ids[a:b], enc.encode(buf, off), strict=True):
                    if writer is None:
                        writer = ShardWriter(f"{folder}/{part:06d}-{n:05d}-{uuid.uuid4().hex}.zst", 2 if enc.size <= 1 << 16 else 4)
                    writer.add(d, np.append(x, end_id))
                    if writer.n_ids >= shard_ids:
                        close()
                        writer, n = None, n + 1
        if writer is not None:
            close()
        encoder.cache_clear()
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "part", "piece", "n_docs", "n_ids"), x, strict=True)) for x in done], pa.schema([("path", pa.string()), ("part", pa.int32()), ("piece", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return stored(mapped(rows, run, "path string, part int, piece int, n_docs long, n_ids long"), "token-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, from the files."""
    order = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0))).select("path", "base").repartition(max(manifest.count(), 1))  # a task for each shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                r = ShardReader(path)
                for at in range(0, len(r.docs), 256):
                    some = r.docs[at : at + 256]
                    ids = [r.ids(at + i) for i in range(len(some))]
                    yield pa.RecordBatch.from_arrays([pa.array(some["doc_id"], mask=some["doc_id"] == NO_ID), pa.array(some["first"].astype(np.int64) + base), pa.array(some["n"].astype(np.int64)), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return mapped(placed, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(paths: Iterable[str], doc_ids: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, ids) of the wanted documents, decompressing only frames that hold them."""
    wanted = np.array(sorted(set(doc_ids)), np.int64)
    for path in paths:
        r = ShardReader(path)
        for row in np.flatnonzero(np.isin(r.docs["doc_id"], wanted)):
            yield int(r.docs["doc_id"][row]), r.ids(int(row))


def token_files(spark: SparkSession, docs: DataFrame, vocabulary: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    return read_shards(write_tokens(docs, vocabulary, folder))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark, table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))

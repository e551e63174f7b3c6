"""Token-ID files: fixed-width bit packing with block offsets.

Layout of a file, all integers little-endian:

    magic "PWTOKEN1", bits u32, block u32
    blocks: ``block`` ids each (the last may be shorter), ``bits`` bits an id,
            lowest bit first, every block starting on a byte
    offsets: byte place of each block, u64
    documents: per document its id i64, a flag u8 (0: the id was null), and the
               place of its first id u64, as three columns
    footer: n_blocks u64, n_docs u64, n_ids u64, start of offsets u64, magic

Any run of ids is read by fetching only the blocks it touches.

Documents lie in ascending doc_id order, nulls first, over files numbered in
that order. A null or empty text is the end id alone. Rows of equal doc_id
follow each other by a hash of their texts. A long text is one document, however
many blocks it takes. An empty table makes no file. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, new_path, tune_arrow, whole
from .storage import open_store, write_whole
from .tokens import WordTokenizer

MAGIC = b"PWTOKEN1"
BLOCK_IDS = 1 << 16
#: Characters of text that a file holds on average.
FILE_CHARS = 32_000_000


def bits_for(vocabulary: int) -> int:
    """The fewest bits that tell ``vocabulary`` ids apart."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if not len(ids):
        return b""
    if int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype("<u4")
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: count * bits].reshape(count, bits)
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)


class TokenFileWriter:
    """Streams documents to ``out``; holds a block of ids and the document table."""

    def __init__(self, out, bits: int, block: int = BLOCK_IDS):
        self.out, self.bits, self.block = out, bits, block
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.offsets: list[int] = []
        self.docs: list[tuple[int, int, int]] = []
        self.at = 16
        out.write(MAGIC + np.array([bits, block], "<u4").tobytes())

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is not None, self.n_ids))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= self.block:
            ids = np.concatenate(self.held)
            cut = len(ids) // self.block * self.block
            for s in range(0, cut, self.block):
                self._emit(ids[s : s + self.block])
            self.held, self.n_held = [ids[cut:]], len(ids) - cut

    def _emit(self, ids: np.ndarray) -> None:
        data = pack_bits(ids, self.bits)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.n_held:
            self._emit(np.concatenate(self.held))
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        for k, kind in enumerate(("<i8", "u1", "<u8")):
            self.out.write(np.array([d[k] for d in self.docs], kind).tobytes())
        self.out.write(np.array([len(self.offsets), len(self.docs), self.n_ids, self.at], "<u8").tobytes() + MAGIC)


class TokenFile:
    """Random access to a file of ``TokenFileWriter``."""

    def __init__(self, address: str):
        store, path = open_store(address)
        self.file = store.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(40, size - 40)
        head = self.file.read_at(16, 0)
        if head[:8] != MAGIC or tail[32:] != MAGIC:
            raise ValueError(f"{address} is no token file")
        self.bits, self.block = (int(x) for x in np.frombuffer(head[8:], "<u4"))
        n_blocks, n_docs, self.n_ids, at = (int(x) for x in np.frombuffer(tail[:32], "<u8"))
        table = self.file.read_at(size - 40 - at, at)
        self.offsets = np.append(np.frombuffer(table, "<u8", n_blocks), at).astype(np.int64)
        ids = np.frombuffer(table, "<i8", n_docs, 8 * n_blocks)
        known = np.frombuffer(table, "u1", n_docs, 8 * (n_blocks + n_docs))
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self.starts = np.append(np.frombuffer(table, "<u8", n_docs, 8 * (n_blocks + n_docs) + n_docs), self.n_ids).astype(np.int64)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop; only their blocks are fetched."""
        if stop <= start:
            return np.empty(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        data = self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        parts = []
        for b in range(first, last + 1):
            count = min(self.block, self.n_ids - b * self.block)
            parts.append(unpack_bits(data[self.offsets[b] - self.offsets[first] : self.offsets[b + 1] - self.offsets[first]], self.bits, count))
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.read(int(self.starts[i]), int(self.starts[i + 1]))

    def documents(self, ids_at_once: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """(place, ids) of every document, read a run of blocks at a time."""
        i, n = 0, len(self.doc_ids)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + ids_at_once, "right")) - 1)
            j = min(j, n)
            ids, base = self.read(int(self.starts[i]), int(self.starts[j])), int(self.starts[i])
            for k in range(i, j):
                yield k, ids[self.starts[k] - base : self.starts[k + 1] - base]
            i = j

    def close(self) -> None:
        self.file.close()


def write_files(docs: DataFrame, tokenizer_path: str, vocabulary: int, end_id: int, file_chars: int = FILE_CHARS, folder: str | None = None) -> DataFrame:
    """Write the files; returns (shard, path, n_docs, n_ids), one row a file.

    Spark cuts the range of doc_id into as many parts as there are files, of
    about ``file_chars`` characters, and one task streams a file; ``shard``
    numbers them in doc_id order. Rows of equal doc_id, even equal ones, may lie
    in several files. Texts are shuffled, as they take less room than their ids.
    """
    spark = docs.sparkSession
    tune_arrow(spark)
    docs = whole(docs).withColumn("mark", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    folder = folder or new_path(spark, "tokens")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, round(chars / file_chars))
    order = [F.col("doc_id").asc_nulls_first(), "mark", "row"]
    dealt = docs.repartitionByRange(shards, *order) if shards > 1 else docs.coalesce(1)
    dealt = dealt.sortWithinPartitions(*order).withColumn("shard", F.spark_partition_id())
    bits = bits_for(vocabulary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if len(b)), None)
        if first is None:
            return
        number = first.column(2)[0].as_py()
        address = f"{folder}/{number:08d}.tok"
        counts = {}

        def fill(out):
            tokenizer, writer = WordTokenizer.at(tokenizer_path), TokenFileWriter(out, bits)
            batch = first
            while batch is not None:
                doc_ids = batch.column(0).to_pylist()
                for at, ids, ends in tokenizer.encode_column(batch.column(1)):
                    for i in range(len(ends) - 1):
                        writer.add(doc_ids[at + i], np.append(ids[ends[i] : ends[i + 1]], np.uint32(end_id)))
                batch = next(batches, None)
            writer.close()
            counts.update(n_docs=len(writer.docs), n_ids=writer.n_ids)

        write_whole(address, fill)
        yield pa.RecordBatch.from_pylist([{"shard": number, "path": address, **counts}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return materialise(dealt.select("doc_id", "text", "shard").mapInArrow(write, "shard int, path string, n_docs long, n_ids long"), "token-manifest")


def read_files(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start over all files, n_tokens, ids_crc32."""
    # one row a file, so a running sum in one task is small at any size
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.repartition(max(1, manifest.count()), "shard")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for address, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(address)
                crc = np.fromiter((zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in file.documents()), np.int64, len(file.doc_ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file.doc_ids, pa.int64()), pa.array(file.starts[:-1] + base, pa.int64()), pa.array(np.diff(file.starts), pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )
                file.close()

    return placed.select("path", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")

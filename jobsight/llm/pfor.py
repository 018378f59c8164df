"""Token ids in files of patched frame-of-reference blocks.

A file holds the ids of a run of documents in ascending order of doc_id. Ids are cut into
blocks of ``BLOCK``. Of each block the minimum is subtracted; the rest is packed with as many
bits as a chosen percentile of the block needs, and the few larger values keep their low bits
in place and add (position, high bits) to the block's list of exceptions.

File layout (little-endian): 8 bytes ``TOKPFOR1``; the blocks; the index: the byte position of
every block, then (doc_id, number of ids) of every document; the footer: number of blocks,
of documents and of ids, and the block size (4 unsigned 64-bit). A block: minimum (u32),
number of values (u16), number of exceptions (u16), width (u8), the packed values, the
positions of the exceptions (u16 each) and their high bits (u32 each).

Files are written below a folder that all executors share, under a name of their own for each
attempt, and renamed when whole; the name of a part is fixed, so a task that runs again
replaces the same file. A task holds one block buffer and one document at a time.

Edge cases: a null or empty text has the end id alone; a null id comes first and is stored by
a flag; rows of one id are in the order of a hash of their text, then of the text, so a rerun
writes the same files, and many of them are dealt over several files; repeated rows are written
each; an empty table writes no file; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window as W, functions as F

from jobsight.session import scratch_path

from .text import arrow_schema, whole_texts
from .tokens import encoder

MAGIC = b"TOKPFOR1"
BLOCK = 1024
#: Share of a block's values that fit its width.
PERCENTILE = 0.95
END = 1
_HEAD = struct.Struct("<IHHB")
_FOOT = struct.Struct("<4Q")
_DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("n", "<u8")])
#: Ids that are coded, or read, at a time.
BUFFER = 256 * BLOCK


def _packed_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below 2^width as rows of bytes."""
    raw = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(len(values), -1, 4)
    bits = np.unpackbits(raw, axis=2, bitorder="little", count=width) if width else np.empty((len(values), values.shape[1], 0), np.uint8)
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def _unpacked_bits(data: np.ndarray, n: int, width: int) -> np.ndarray:
    """The inverse, for rows of bytes."""
    if not width:
        return np.zeros((len(data), n), np.uint32)
    bits = np.unpackbits(data, axis=1, count=n * width, bitorder="little").reshape(len(data), n, width)
    full = np.packbits(bits, axis=2, bitorder="little")
    out = np.zeros((len(data), n, 4), np.uint8)
    out[:, :, :full.shape[2]] = full
    return out.view("<u4").reshape(len(data), n)


def encode_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> list[bytes]:
    """Coded blocks of ids; only the last may be shorter than ``block``."""
    whole = len(ids) // block * block
    out = _encode_rows(ids[:whole].reshape(-1, block), percentile) if whole else []
    return out + (_encode_rows(ids[whole:].reshape(1, -1), percentile) if whole < len(ids) else [])


def _encode_rows(rows: np.ndarray, percentile: float) -> list[bytes]:
    least = rows.min(axis=1)
    rest = rows - least[:, None]
    n = rows.shape[1]
    at = max(0, int(np.ceil(percentile * n)) - 1)
    typical = np.partition(rest, at, axis=1)[:, at]
    widths = np.ceil(np.log2(typical.astype(np.float64) + 1)).astype(int)
    out: list[bytes] = [b""] * len(rows)
    for width in np.unique(widths).tolist():
        which = np.flatnonzero(widths == width)
        some = rest[which]
        packed = _packed_bits(some & np.uint32((1 << width) - 1), width)
        high = some >> np.uint32(width) if width < 32 else np.zeros_like(some)
        for i, w in enumerate(which.tolist()):
            odd = np.flatnonzero(high[i])
            out[w] = b"".join([
                _HEAD.pack(int(least[w]), n, len(odd), width), packed[i].tobytes(),
                odd.astype("<u2").tobytes(), high[i][odd].astype("<u4").tobytes(),
            ])
    return out


def decode_block(data: bytes) -> np.ndarray:
    """Ids of one coded block."""
    least, n, odd, width = _HEAD.unpack_from(data)
    size = (n * width + 7) // 8
    packed = np.frombuffer(data, np.uint8, size, _HEAD.size)
    values = _unpacked_bits(packed.reshape(1, -1), n, width)[0]
    if odd:
        where = np.frombuffer(data, "<u2", odd, _HEAD.size + size)
        values[where] |= np.frombuffer(data, "<u4", odd, _HEAD.size + size + 2 * odd) << np.uint32(width)
    return values + np.uint32(least)


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


class Writer:
    """Writes one file; ``close`` gives it its name."""

    def __init__(self, folder: str, name: str, block: int = BLOCK, percentile: float = PERCENTILE) -> None:
        self._fs, root = _opened(folder)
        self._fs.create_dir(root, recursive=True)
        self._path, self._tried = f"{root}/{name}", f"{root}/.{name}-{uuid.uuid4().hex}"
        self._file = self._fs.open_output_stream(self._tried)
        self._file.write(MAGIC)
        self._at, self._block, self._percentile = len(MAGIC), block, percentile
        self._waiting, self._waits, self._starts, self._docs, self.n_ids = [], 0, [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._docs.append((doc_id or 0, doc_id is None, len(ids)))
        for start in range(0, len(ids), BUFFER):
            part = ids[start:start + BUFFER]
            self._waiting.append(part)
            self._waits += len(part)
            if self._waits >= BUFFER:
                self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([*self._waiting, np.empty(0, np.uint32)]).astype(np.uint32)
        now = len(ids) if last else len(ids) // self._block * self._block
        for coded in encode_blocks(ids[:now], self._block, self._percentile):
            self._starts.append(self._at)
            self._file.write(coded)
            self._at += len(coded)
        self.n_ids += now
        self._waiting, self._waits = [ids[now:]], len(ids) - now

    def close(self) -> dict:
        self._flush(True)
        docs = np.array(self._docs, _DOC)
        tail = np.array(self._starts, "<u8").tobytes() + docs.tobytes()
        self._file.write(tail + _FOOT.pack(len(self._starts), len(docs), self.n_ids, self._block))
        self._file.close()
        self._fs.move(self._tried, self._path)
        return {"docs": len(docs), "ids": self.n_ids, "bytes": self._at + len(tail) + _FOOT.size}


def read_file(folder: str, name: str) -> Iterator[tuple[int | None, Iterator[np.ndarray]]]:
    """(doc_id, runs of its ids) of every document in a file, in its order; blocks are read as they are needed."""
    fs, root = _opened(folder)
    with fs.open_input_file(f"{root}/{name}") as file:
        size = file.size()
        blocks, n_docs, _, _ = _FOOT.unpack(file.read_at(_FOOT.size, size - _FOOT.size))
        at = size - _FOOT.size - n_docs * _DOC.itemsize - 8 * blocks
        starts = np.r_[np.frombuffer(file.read_at(8 * blocks, at), "<u8").astype(np.int64), at]
        docs = np.frombuffer(file.read_at(n_docs * _DOC.itemsize, at + 8 * blocks), _DOC)
        run, near = np.empty(0, np.uint32), 0

        def ids(n: int) -> Iterator[np.ndarray]:
            nonlocal run, near
            while n:
                if not len(run):  # the next blocks, in one read
                    upto = min(near + BUFFER // BLOCK, blocks)
                    data, first = file.read_at(int(starts[upto] - starts[near]), int(starts[near])), int(starts[near])
                    cuts = (starts[near:upto + 1] - first).tolist()
                    run = np.concatenate([decode_block(data[a:b]) for a, b in zip(cuts, cuts[1:])])
                    near = upto
                taken, run = run[:n], run[n:]
                n -= len(taken)
                yield taken

        for doc_id, null, n in docs.tolist():
            yield (None if null else doc_id), ids(n)


def read_ids(folder: str, name: str, block: int) -> np.ndarray:
    """Ids of one block, found by the index."""
    fs, root = _opened(folder)
    with fs.open_input_file(f"{root}/{name}") as file:
        size = file.size()
        blocks, n_docs, _, _ = _FOOT.unpack(file.read_at(_FOOT.size, size - _FOOT.size))
        at = size - _FOOT.size - n_docs * _DOC.itemsize - 8 * blocks
        first = int.from_bytes(file.read_at(8, at + 8 * block), "little")
        last = int.from_bytes(file.read_at(8, at + 8 * block + 8), "little") if block + 1 < blocks else at
        return decode_block(file.read_at(last - first, first))


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end: int = END, block: int = BLOCK,
                      percentile: float = PERCENTILE) -> DataFrame:
    """Write the ids of all texts in ascending order of doc_id, one file per range of ids, and
    return the table of files (part, name, docs, ids, bytes), which is one row per task."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ranged = whole_texts(docs, F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")).repartitionByRange(tasks, *order)
    ranged = ranged.sortWithinPartitions(*order, "text").select(F.spark_partition_id().alias("part"), "doc_id", "text")
    schema = "part int, name string, docs long, ids long, bytes long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, part, name = None, 0, ""
        encode, tail = encoder(tokenizer).encode, end.to_bytes(4, "little")
        for batch in batches:
            for part_, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if writer is None:
                    part, name = part_, f"part-{part_:06d}.pfor"
                    writer = Writer(folder, name, block, percentile)
                writer.add(doc_id, np.frombuffer(encode(text.as_py()) + tail, "<u4"))
        if writer is not None:
            yield pa.RecordBatch.from_pylist([{"part": part, "name": name, **writer.close()}], schema=arrow)

    arrow = arrow_schema(docs, schema)
    files = ranged.mapInArrow(run, schema)
    # Written, so that the files are there, once, before anything reads them.
    path = f"{folder}/_files"
    files.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # over one row per file
    placed = files.select("part", "name", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first"))
    spread = placed.repartition(max(1, files.count()), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out, start = [], row["first"]
                for doc_id, runs in read_file(folder, row["name"]):
                    crc, n = 0, 0
                    for ids in runs:
                        crc, n = zlib.crc32(ids.astype("<u4").tobytes(), crc), n + len(ids)
                    out.append({"doc_id": doc_id, "start": start, "n_tokens": n, "ids_crc32": crc})
                    start += n
                    if len(out) >= 4096:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = arrow_schema(files, schema)
    return spread.mapInArrow(run, schema)


def token_files(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Write token files below the shared folder and read them back, one row per document."""
    folder = scratch_path(docs.sparkSession, "token_files")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read_token_files(write_token_files(docs, tokenizer, folder, end), folder)

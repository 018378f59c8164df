"""Best-fit packing of documents into sequences, by hierarchical residual packing.

Documents become token ids and a final end id; only a document longer than a sequence is cut,
into pieces of exactly one sequence and a rest. Each task packs the pieces of its own rows
best-fit (longest first, into the fullest sequence with room) and emits the sequences that
are nearly full. The underfull ones then meet others as items: they are dealt to fewer tasks,
packed best-fit again, and so on up a tree until one task holds all that is left. Sequences
without room for the smallest item left can never change and leave the tree, so only those
that something still fits go on. A task holds ``ITEMS`` items at most in a round, whatever the
size of the input; a sequence travels with the list of its pieces, of which there are at
most ``length``, so no join is needed.

Edge cases: a null or empty text is one piece with the end id alone; repeated rows are packed
each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from jobsight.session import stage

from .text import arrow_schema, whole_texts
from .tokens import encoder

LENGTH = 2048
END = 0
#: Sequences with at most length / SLACK free places are full enough.
SLACK = 64
#: Items that one task packs in a round.
ITEMS = 50_000

_PIECE = "doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint"
BINS = f"fill int, pieces array<struct<{_PIECE}>>"


def cut(ids: bytes, length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of ids packed as little-endian unsigned 32-bit."""
    step = 4 * length
    return [
        (i, at // 4, (min(at + step, len(ids)) - at) // 4, zlib.crc32(ids[at:at + step]))
        for i, at in enumerate(range(0, len(ids), step))
    ]


def best_fit(sizes: np.ndarray, length: int = LENGTH) -> list[list[int]]:
    """Bins of item indexes: longest item first, each into the fullest bin with room.

    Bins are kept by their room, and the set of rooms in use is one integer, so an item finds
    its bin in a few operations however many bins are open."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms = 0  # bit r is set if some bin has room r
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[at].append(item)
        else:
            room, at = length, len(bins)
            bins.append([item])
        left = room - size
        if not by_room[left]:
            rooms |= 1 << left
        by_room[left].append(at)
    return bins


def _packed(items: list[dict], length: int) -> list[dict]:
    """Pack (fill, pieces) rows; pieces of a bin follow one another."""
    items.sort(key=lambda r: (-r["fill"], r["pieces"][0]["doc_id"] or 0, r["pieces"][0]["piece"]))
    sizes = np.array([r["fill"] for r in items], np.int64)
    return [
        {"fill": int(sizes[b].sum()), "pieces": [p for i in b for p in items[i]["pieces"]]}
        for b in best_fit(sizes, length)
    ]


def packed_locally(docs: DataFrame, tokenizer: str, end: int = END, length: int = LENGTH) -> DataFrame:
    """Bins (fill, pieces) of the rows of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = encoder(tokenizer).encode, end.to_bytes(4, "little")
        items: list[dict] = []

        def out(full: bool) -> list[pa.RecordBatch]:
            rows = _packed(items, length)
            items[:] = [r for r in rows if r["fill"] < length // 2] if not full else []
            done = [r for r in rows if full or r["fill"] >= length // 2]
            return [pa.RecordBatch.from_pylist(done[i:i + 4096], schema=arrow) for i in range(0, len(done), 4096)]

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for piece, start, size, crc in cut(encode(text.as_py()) + tail, length):
                    items.append({"fill": size, "pieces": [
                        {"doc_id": doc_id, "piece": piece, "start": start, "length": size, "ids_crc32": crc}]})
                if len(items) >= ITEMS:
                    yield from out(False)
        yield from out(True)

    arrow = arrow_schema(docs, BINS)
    return whole_texts(docs).mapInArrow(run, BINS)


def _repacked(bins: DataFrame, tasks: int, length: int, turn: int) -> DataFrame:
    """Pack the bins again as items, dealt to so many tasks by their first piece, anew in every turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [r for batch in batches for r in batch.to_pylist()]
        rows = _packed(items, length)
        for i in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_pylist(rows[i:i + 4096], schema=arrow)

    arrow = arrow_schema(bins, BINS)
    return bins.repartition(tasks, F.xxhash64(F.lit(turn), F.col("pieces")[0])).mapInArrow(run, BINS)


def pack(docs: DataFrame, tokenizer: str, end: int = END, length: int = LENGTH, slack: int = SLACK) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    nearly = length - length // slack
    bins, done = stage(packed_locally(docs, tokenizer, end, length), "packed"), []
    for turn in count():
        least = bins.where(F.col("fill") < nearly).agg(F.min("fill")).first()[0]
        fits = (F.col("fill") < nearly) & (F.col("fill") + F.lit(length if least is None else least) <= length)
        n = bins.where(fits).count()
        if n < 2:
            break
        done.append(bins.where(~fits))
        tasks = ceil(n / ITEMS)
        bins = stage(_repacked(bins.where(fits), tasks, length, turn), "packed")
        if tasks == 1:
            break
    sequences = bins
    for part in done:
        sequences = sequences.unionByName(part)
    # The bins are written tables, so a sequence keeps its number when a task runs again.
    numbered = sequences.select(F.monotonically_increasing_id().alias("sequence_id"), "pieces")
    before = F.aggregate(
        "pieces", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts")),
        lambda acc, p: F.struct((acc["at"] + p["length"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")),
        lambda acc: acc["starts"],
    )
    placed = numbered.select("sequence_id", F.explode(F.arrays_zip(F.col("pieces").alias("p"), before.alias("at"))).alias("z"))
    return placed.select("z.p.*", "sequence_id", F.col("z.at").alias("offset"))

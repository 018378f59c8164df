"""SimHash near-duplicates: fingerprints of word shingles, linked by vantage-point trees.

Edge cases: a null text counts as empty; a text of fewer words than a shingle is hashed as a
whole; one without words has the fingerprint zero, which links like any other; repeated rows
have one fingerprint and so one component; a null id is never the smallest of a component
that has another; an empty table gives an empty result; other columns are not read
(``simhash_groups``) or kept (``keep_one_per_group``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from jobsight.session import stage

from .components import components
from .hamming import RADIUS, near_links
from .spread import join_one
from .text import map_rows, pieces, whole_texts

SHINGLE = 4
SEED = 42


def _shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """Hashes of all shingles of a text, a run of words at a time."""
    hashed, kept, seen = xxhash.xxh64_intdigest, [], 0
    for piece in pieces(text):
        words = kept + piece.split()
        seen += len(words) - len(kept)
        kept = words[-(width - 1):] if width > 1 else []
        if len(words) < width:
            kept = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.r_[0, ends[:-1] + 1]
        spans = zip(starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist())
        yield np.array([hashed(joined[a:b], SEED) for a, b in spans], np.uint64)
    if 0 < seen < width:
        yield np.array([hashed(b" ".join(kept), SEED)], np.uint64)


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is 1 if it is set in over half of the shingle hashes."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in _shingle_hashes(text.lower(), width):
        n += len(hashes)
        for start in range(0, len(hashes), 1 << 14):
            bits = np.unpackbits(hashes[start:start + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(docs: DataFrame, width: int = SHINGLE, *more: Column, schema: str = "doc_id long, fp long") -> DataFrame:
    """(doc_id, fp, more) with the fingerprint as a signed long; ``schema`` names what is returned."""

    def per_batch(rows: list[dict]) -> list[dict]:
        marks = np.array([fingerprint(r.pop("text"), width) for r in rows], np.uint64).view(np.int64).tolist()
        return [{**r, "fp": m} for r, m in zip(rows, marks)]

    return map_rows(whole_texts(docs, *more), per_batch, schema)


def simhash_groups(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id."""
    marks = stage(fingerprints(docs, width), "fingerprints")
    roots = components(near_links(marks, radius))
    known = marks.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    known = known.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    known = stage(known.select("fp", "first", "rows", F.coalesce("root", "fp").alias("root")), "prints")
    lowest = stage(known.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("prints")), "groups")
    # A print with many rows and a component of many prints are both dealt over all tasks.
    named = stage(join_one(known, lowest, "root", "prints", F.xxhash64("fp")).select("fp", "rows", "component_id"), "named_prints")
    return join_one(marks, named, "fp", "rows", F.xxhash64("doc_id")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _content(row: Column) -> Column:
    """Digest of a whole row."""
    return F.unhex(F.sha2(F.to_json(row), 256))


def keep_one_per_group(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` per component, all columns kept: the one with the smallest id, a null id
    last; of rows with that id the first by content. Rows are told apart by their whole content, so
    null ids and ids that several texts share mix nothing."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    marks = stage(fingerprints(rows, width, _content(F.col("_row")).alias("content"),
                               schema="doc_id long, content binary, fp long"), "fingerprints")
    roots = components(near_links(marks, radius))
    known = marks.groupBy("fp", "doc_id", "content").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "content", "n")
    firsts = known.groupBy("fp").agg(F.min(order).alias("first"))
    firsts = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    best = firsts.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    stay = stage(best.select("first.content", "first.n"), "simhash_kept")
    rows = rows.select("_row", _content(F.col("_row")).alias("content"))
    # The rows that stay grow with the corpus: they are never broadcast, at no size.
    alone = rows.join(stay.where("n = 1").hint("merge"), "content").select("_row")
    repeated = stay.where("n > 1")
    if not repeated.isEmpty():  # rows that are the same in all columns: one of them
        again = rows.join(repeated.hint("merge"), "content")
        alone = alone.unionByName(again.groupBy("content").agg(F.first("_row").alias("_row")).select("_row"))
    return alone.select(*[F.col(f"_row.`{c}`") for c in docs.columns])

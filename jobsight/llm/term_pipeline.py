"""Ranked lexical search by pipelined term partitioning.

Index: a task deals its documents into blocks of at most ``BLOCK`` documents and inverts each
block: one posting row per term, with the places of the documents in the block, the counts of the
term and the lengths of the documents. All terms are indexed, whatever is asked.

Search: every term of the items has one owner out of ``OWNERS``. Owners are cut by the terms'
weights, rare terms first, so that each owns about the same number of postings. Items are dealt
into bundles. A bundle visits the owners one after the other, once per block of documents: it
carries a sparse accumulator of scores per item, is cogrouped with the owner's postings of its
terms in that block, adds their integer contributions, and goes on to the next owner. After the
last one each item's best documents of the block are selected, and then the best of all blocks.

Between two owners an accumulator drops documents that cannot come to be among the item's ``k``
best of the block: those whose score, plus the most that the item's later terms can add, is below
the k-th score reached so far. What is dropped could come back with a part of its score only, and
even its whole score is too low, so results are exact.

A group is one bundle in one block: at most ``BUNDLE`` items (on average half of it) and ``BLOCK``
documents, however common a term or large a corpus is. Weights need the numbers of documents and
terms of all documents; these are sums over the index.

Terms are the runs of letters and digits of ASCII and of all other characters; A to Z count as a
to z.

Edge cases: null and empty texts have no term and take no part; documents with one id are ranked
each; null ids come last among equal scores; repeated item rows (same id and text) are one item,
items that share an id with another text are items of their own under that id; an item without a
term that some document holds has no row; empty tables give an empty result; other columns are
not read. A text is read in pieces, so a task holds the distinct terms of a block and one text.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from jobsight.session import scratch_path, stage

from .text import arrow_schema, pieces

K = 20
#: Documents of a block at most; places are unsigned 16-bit.
BLOCK = 4096
#: Postings of a block at most, apart from its last document.
POSTINGS = 1 << 20
OWNERS, BUNDLE = 4, 256
#: A term adds less than its weight times this to a score.
TOP = 1_000_000
# Bytes that end a term become spaces, A to Z become a to z.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BUNDLES = "block long, bundle int, item long, rest long, places binary, scores binary"
_POSTINGS = "block long, bundle int, weight long, asked array<struct<item:long,times:long,rest:long>>, places binary, counts binary, lengths binary, owner int"
_INDEX = "block long, term binary, n int, places binary, counts binary, lengths binary, ids array<long>, total long"


def terms(text: bytes) -> Counter:
    """The terms of a whole text with their numbers of occurrences."""
    found: Counter = Counter()
    for piece in pieces(text):
        found.update(piece.translate(_TERMS).split())
    return found


class _Block:
    """The documents of one block, inverted by term. A posting takes eight bytes until then."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.lengths, self.sizes = array("Q"), array("I")
        self.number, self.count = array("I"), array("I")
        self.numbers: dict[bytes, int] = {}

    def add(self, doc_id: int | None, counts: Counter) -> None:
        self.ids.append(doc_id)
        self.lengths.append(counts.total())
        self.sizes.append(len(counts))
        self.number.extend([self.numbers.setdefault(t, len(self.numbers)) for t in counts])
        self.count.extend(counts.values())

    def rows(self, block: int, at_once: int = 20_000) -> Iterator[dict[str, list]]:
        """Columns of the posting rows, some terms at a time, after a row with the ids of the
        documents. Places are in ascending order of ids, nulls last."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.uint16)
        place[order] = np.arange(len(order), dtype=np.uint16)
        lengths = np.array(self.lengths, np.int64)
        yield {
            "block": [block], "term": [None], "n": [len(order)], "places": [None], "counts": [None], "lengths": [None],
            "ids": [[self.ids[i] for i in order]], "total": [int(lengths.sum())],
        }
        doc = np.repeat(np.arange(len(order), dtype=np.uint16), np.array(self.sizes))
        number = np.array(self.number)
        by_term = np.lexsort((place[doc], number))
        doc, counts = doc[by_term], np.array(self.count, np.uint32)[by_term]
        places, of_doc = place[doc], lengths[doc].astype(np.uint32)
        ends = np.cumsum(np.bincount(number, minlength=len(self.numbers))).tolist()
        starts, names = [0, *ends[:-1]], list(self.numbers)
        for first in range(0, len(names), at_once):
            some = list(zip(starts[first:first + at_once], ends[first:first + at_once]))
            cut = lambda a: [a[s:e].tobytes() for s, e in some]
            yield {
                "block": [block] * len(some), "term": names[first:first + at_once], "n": [e - s for s, e in some],
                "places": cut(places), "counts": cut(counts), "lengths": cut(of_doc), "ids": [None] * len(some), "total": [None] * len(some),
            }


def build_index(docs: DataFrame) -> DataFrame:
    """Posting rows (block, term, n, places, counts, lengths) and one row per block with a null
    term, the number of its documents, their ids and the total of their lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, made = _Block(), 0

        def done() -> Iterator[pa.RecordBatch]:
            for columns in block.rows((part << 32) + made):
                yield pa.RecordBatch.from_pydict(columns, schema=arrow)

        for batch in batches:
            for part, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                counts = terms(text.as_py())
                if not counts:
                    continue
                block.add(doc_id, counts)
                if len(block.ids) >= BLOCK or len(block.number) >= POSTINGS:
                    yield from done()
                    block, made = _Block(), made + 1
        if block.ids:
            yield from done()

    arrow = arrow_schema(docs, _INDEX)
    rows = docs.where(F.col("text").isNotNull()).select(
        F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, _INDEX)


def item_terms(items: DataFrame, bundles: int) -> DataFrame:
    """(bundle, item, term, times) of numbered items (item, text)."""
    schema = "bundle int, item long, term binary, times long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = {"bundle": row["item"] % bundles, "item": row["item"]}
                found = [own | {"term": t, "times": n} for t, n in terms(row["text"]).items()]
                yield pa.RecordBatch.from_pylist(found, schema=arrow)

    arrow = arrow_schema(items, schema)
    return items.mapInArrow(run, schema)


def owned_terms(asked: DataFrame, index: DataFrame, docs: int, owners: int) -> DataFrame:
    """(bundle, term, owner, weight, asked): every term of a bundle with its owner, and the items
    that ask for it with its times in the item and the most that later owners can add to the item."""
    held = index.join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    weighed = stage(held.select("term", "df", weight.alias("weight")), "term_weights")
    shares = F.array(*[F.lit(1.0 - i / owners) for i in range(1, owners)])
    cuts = weighed.agg(F.percentile("weight", shares, F.col("df"))).first()[0] or []  # weights are few whole numbers
    owner = sum((F.col("weight") < cut).cast("int") for cut in cuts) if cuts else F.lit(0)
    later = W.partitionBy("item").orderBy(-F.col("owner")).rangeBetween(W.unboundedPreceding, -1)
    rest = F.coalesce(F.sum(F.col("times") * F.col("weight") * TOP).over(later), F.lit(0)).cast("long")
    each = asked.join(weighed, "term").withColumn("owner", owner).withColumn("rest", rest)
    return each.groupBy("bundle", "term", "owner", "weight").agg(F.collect_list(F.struct("item", "times", "rest")).alias("asked"))


def visit(carried: DataFrame, owned: DataFrame, docs: int, total: int, k: int) -> DataFrame:
    """Carry bundles through one owner: the accumulators (block, bundle, item, rest, places,
    scores) with the contributions of its posting rows, without places that cannot be chosen."""

    def add(key: tuple, bundle: pd.DataFrame, postings: pd.DataFrame) -> pd.DataFrame:
        rest = dict(zip(bundle["item"].tolist(), bundle["rest"].tolist()))
        for row in postings["asked"]:
            rest.update((a["item"], a["rest"]) for a in row)
        row_of = {item: i for i, item in enumerate(sorted(rest))}
        scores = np.zeros((len(row_of), BLOCK), np.int64)
        for item, places, own in zip(bundle["item"].tolist(), bundle["places"], bundle["scores"]):
            scores[row_of[item], np.frombuffer(places, "<u2")] = np.frombuffer(own, "<i8")
        for p in postings.itertuples():
            places = np.frombuffer(p.places, "<u2")
            tf, n = (np.frombuffer(b, "<u4").astype(np.int64) for b in (p.counts, p.lengths))
            gain = p.weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))
            for a in p.asked:
                scores[row_of[a["item"]], places] += a["times"] * gain
        out = []
        for item, i in row_of.items():
            places = np.flatnonzero(scores[i])
            own = scores[i][places]
            if len(own) > k:
                kept = own + rest[item] >= np.partition(own, len(own) - k)[len(own) - k]
                places, own = places[kept], own[kept]
            if len(own):
                out.append((*key, item, rest[item], places.astype("<u2").tobytes(), own.astype("<i8").tobytes()))
        return pd.DataFrame(out, columns=["block", "bundle", "item", "rest", "places", "scores"])

    key = ["block", "bundle"]
    return carried.groupBy(*key).cogroup(owned.groupBy(*key)).applyInPandas(add, _BUNDLES)


def selected(carried: DataFrame, k: int) -> DataFrame:
    """(block, item, place, score): each item's ``k`` best of every block."""
    schema = "block long, item long, place int, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                places, own = np.frombuffer(row["places"], "<u2"), np.frombuffer(row["scores"], "<i8")
                best = np.lexsort((places, -own))[:k]  # equal scores: the smallest ids
                n = len(best)
                yield pa.RecordBatch.from_pydict({"block": [row["block"]] * n, "item": [row["item"]] * n, "place": places[best], "score": own[best]}, schema=arrow)

    arrow = arrow_schema(carried, schema)
    return carried.select("block", "item", "places", "scores").mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, k: int = K, owners: int = OWNERS, bundle: int = BUNDLE) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` highest-scoring documents."""
    spark = docs.sparkSession
    told = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    numbered = stage(told.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "search_items")
    bundles = max(1, -(-numbered.count() // bundle))
    asked = item_terms(numbered.select("item", F.col("text").cast("binary").alias("text")), bundles)
    whole = stage(build_index(docs), "term_index")
    blocks, index = whole.where(F.col("term").isNull()), whole.where(F.col("term").isNotNull())
    n, total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    # Written, so that Spark knows its size before it chooses how to join the index with it.
    owned = stage(owned_terms(stage(asked, "item_terms"), index, n, owners), "owned_terms")
    # Written by owner, so that every visit reads its owner's postings alone.
    path = scratch_path(spark, "owned_postings")
    index.join(owned, "term").select("owner", "block", "bundle", "weight", "asked", "places", "counts", "lengths").write.partitionBy("owner").parquet(path)
    postings = spark.read.schema(_POSTINGS).parquet(path)
    carried = spark.createDataFrame([], _BUNDLES)
    for owner in range(owners):
        carried = visit(carried, postings.where(F.col("owner") == owner), n, total, k)
    best = selected(carried, k).join(blocks.select("block", "ids"), "block")
    best = best.select("item", F.element_at("ids", F.col("place") + 1).alias("doc_id"), "score")
    order = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    ranked = best.withColumn("rank", order).where(F.col("rank") <= k)
    return ranked.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


#: The same in DuckDB, by joining all items with all postings of their terms.
SQL = r"""
    WITH tokens AS (
        SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
        FROM documents),
    held AS (SELECT doc, doc_id, t, CAST(len(t) AS BIGINT) AS n FROM tokens WHERE len(t) > 0),
    whole AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM held),
    posted AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(t) AS term FROM held) GROUP BY doc, term),
    weighed AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM posted, whole GROUP BY term, nn),
    items AS (SELECT row_number() OVER () AS item, * FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark)),
    asked AS (
        SELECT item, term, count(*) AS times FROM (SELECT item, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM items)
        GROUP BY item, term),
    scored AS (
        SELECT item, p.doc, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll)))) AS BIGINT) AS score
        FROM asked a JOIN weighed x USING (term) JOIN posted p USING (term) JOIN held h ON h.doc = p.doc, whole GROUP BY item, p.doc, doc_id)
    SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM scored JOIN items USING (item)
    WHERE score > 0 WINDOW w AS (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) QUALIFY rank <= 20
"""

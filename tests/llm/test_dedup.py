"""Exact and near duplicates against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from jobsight.llm import components, exact_dedup, hamming, simhash


def low(i):
    return -1 if i is None else i


def by_text(doc_rows):
    groups = defaultdict(list)
    for i, t in doc_rows:
        groups[t or ""].append(i)
    return groups


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.pmod(F.length(t), F.lit(3)).cast("string")])
def test_exact_groups(docs, doc_rows, digest):
    """Also with a digest that many different texts share: contents decide."""
    got = [r.asDict() for r in exact_dedup.duplicate_groups(docs, digest).collect()]
    want = Counter()
    for text, ids in by_text(doc_rows).items():
        keep, seen = max(ids, key=low), False
        for i in ids:
            stays = i == keep and not seen
            seen = seen or stays
            want[i, keep, len(ids), stays, hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.lit("same")])
def test_exact_keeps_rows(docs, doc_rows, digest):
    kept = exact_dedup.keep_one_of_each(docs, digest)
    assert kept.columns == docs.columns
    rows = kept.collect()
    groups = by_text(doc_rows)
    assert Counter((r["text"] or "", r["doc_id"]) for r in rows) == Counter((t, max(ids, key=low)) for t, ids in groups.items())
    assert {r["_row"] for r in rows} == {"kept _row"}


def test_exact_empty(empty):
    assert exact_dedup.duplicate_groups(empty).count() == 0
    assert exact_dedup.keep_one_of_each(empty).count() == 0


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points, radius):
    """Smallest index reachable, by flooding."""
    root = [-1] * len(points)
    for i in range(len(points)):
        todo = [i] if root[i] < 0 else []
        while todo:
            at = todo.pop()
            if root[at] < 0:
                root[at] = i
                todo += [j for j in range(len(points)) if root[j] < 0 and bin(points[at] ^ points[j]).count("1") <= radius]
    return root


def test_simhash_groups(docs, doc_rows):
    got = [tuple(r) for r in simhash.simhash_groups(docs).collect()]
    prints = [brute_fingerprint(t) for _, t in doc_rows]
    distinct = sorted(set(prints))
    root = dict(zip(distinct, brute_components(distinct, 4)))
    smallest = defaultdict(list)
    for (i, _), p in zip(doc_rows, prints):
        smallest[root[p]].append(i)
    first = {k: min((i for i in v if i is not None), default=None) for k, v in smallest.items()}
    assert Counter(got) == Counter((i, f"{p:016x}", first[root[p]]) for (i, _), p in zip(doc_rows, prints))


def test_simhash_keeps_one(docs):
    kept = simhash.keep_one_per_group(docs)
    groups = simhash.simhash_groups(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) == groups.select("component_id").distinct().count()


def test_simhash_keeps_one_of_null_and_reused_ids(spark):
    """Different texts without an id, or with one id, all stay; a near copy goes, whatever its id."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 80)) for _ in range(12)]
    near = " ".join([*texts[9].split(), "other"])
    assert bin(brute_fingerprint(near) ^ brute_fingerprint(texts[9])).count("1") <= 4
    rows = [(None, t, 0) for t in texts[:5]] + [(7, t, 0) for t in texts[5:8]]
    rows += [(None, texts[8], 0)] * 3 + [(8, texts[9], 0), (None, near, 0), (7, texts[10], 0), (7, texts[10], 1), (9, texts[10], 0), (10, texts[11], 0), (None, texts[11], 0)]
    assert len({*brute_components([brute_fingerprint(t) for t in texts], 4)}) == len(texts)
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    kept = [tuple(r) for r in simhash.keep_one_per_group(docs).collect()]
    want = [*rows[:8], (None, texts[8], 0), (8, texts[9], 0), (10, texts[11], 0)]
    assert Counter(r for r in kept if r[1] != texts[10]) == Counter(want)
    assert [r[0] for r in kept if r[1] == texts[10]] == [7]
    # One row without an id whose text is its own does not bring back the near copies.
    few = docs.where(F.col("text").isin(texts[0], texts[9], near))
    assert Counter(tuple(r) for r in simhash.keep_one_per_group(few).collect()) == Counter([rows[0], (8, texts[9], 0)])


def test_simhash_empty(empty):
    assert simhash.simhash_groups(empty).count() == 0
    assert simhash.keep_one_per_group(empty).count() == 0


def test_fingerprint_of_text_in_pieces(monkeypatch):
    """A text longer than a piece has the fingerprint of the whole."""
    text = " ".join(f"Word{i * i % 997}" for i in range(3000))
    whole = brute_fingerprint(text)
    from jobsight.llm import text as texts

    monkeypatch.setattr(simhash, "pieces", lambda t: texts.pieces(t, 100))
    assert simhash.fingerprint(text.encode()) == whole


@pytest.mark.parametrize("n,bits,seed", [(3000, 24, 0), (1500, 12, 1), (700, 64, 2), (65, 7, 3)])
def test_tree_finds_all_components(n, bits, seed):
    """Dense and sparse sets: the tree's forest has the components of all pairs."""
    rng = np.random.default_rng(seed)
    raw = rng.integers(0, 1 << 63, n, dtype=np.uint64) & np.uint64((1 << bits) - 1)
    noise = np.uint64(1) << rng.integers(0, 60, n, dtype=np.uint64)
    points = np.unique(np.concatenate([raw, raw ^ noise]))
    forest = list(range(len(points)))

    def find(i):
        while forest[i] != i:
            i = forest[i]
        return i

    for a, b in hamming.spanning_links(points):
        assert bin(int(points[a] ^ points[b])).count("1") <= 4
        assert find(a) != find(b)
        forest[max(find(a), find(b))] = min(find(a), find(b))
    assert len({find(i) for i in range(len(points))}) == len(set(brute_components([int(p) for p in points], 4)))


def test_near_links_in_a_hot_shard(spark):
    """Many fingerprints with equal high bits share shards; none of their links is lost."""
    rng = np.random.default_rng(4)
    points = np.unique(rng.integers(0, 1 << 22, 1200, dtype=np.uint64) | np.uint64(0xF << 60))
    frame = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    found = components.components(hamming.near_links(frame)).collect()
    want = brute_components([int(p) for p in points], 4)
    roots = {r["node"]: r["root"] for r in found}
    groups = defaultdict(set)
    for p, w in zip(points.view(np.int64).tolist(), want):
        groups[w].add(roots.get(p, p))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_masks_cover_every_pair():
    """Any 4 differing bits leave one mask untouched."""
    rng = np.random.default_rng(5)
    for _ in range(2000):
        diff = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(not diff & m for m in hamming.masks())


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (202, 201)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert roots == {**{i: 0 for i in range(101)}, 200: 200, 201: 200, 202: 200}

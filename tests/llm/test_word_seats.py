"""Scores by the words before, against plain sums over the seats that were written."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from jobsight.llm import hpylm, word_seats

HELD = [i for i in range(5000) if zlib.crc32(str(i).encode()) % 5 == 1]
LEARNED = [i for i in range(5000) if zlib.crc32(str(i).encode()) % 5 != 1]


def scores(spark, learned, asked):
    rows = [(LEARNED[k], t) for k, t in enumerate(learned)] + [(HELD[k], t) for k, t in enumerate(asked)]
    got = hpylm.scored_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    by_id = {r["doc_id"]: r["score"] for r in got}
    return [10 ** by_id[HELD[k]] for k in range(len(asked))]


def test_words_of_one_class_are_contexts_of_their_own(spark):
    """'nation' and 'station' end alike, so one class holds both, but other words follow them."""
    assert hpylm.context_of(b"nation") == hpylm.context_of(b"station")
    learned = ["nation river stone"] * 40 + ["station lamp garden"] * 40
    right, wrong, other, mixed = scores(spark, learned, ["nation river stone", "nation lamp garden", "station lamp garden", "station river stone"])
    assert right > 5 * wrong and other > 5 * mixed


def test_probabilities_sum_to_one(spark):
    """After every word, and at the start of a text, over all words, an unknown one and the end."""
    rng = random.Random(4)
    words = "the of river stone a lamp nation station".split()
    learned = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 12))) for _ in range(80)]
    words.append("neverseen")
    asked = ["", *words, *[f"{v} {w}" for v in words for w in words]]
    p = scores(spark, learned, asked)
    one = np.array(p[1:len(words) + 1])
    ratio = np.array(p[len(words) + 1:]).reshape(len(words), -1) / one[:, None]
    # p(v) = x(v) e(v), p(v w) = x(v) q(w | v) e(w), with e(v) of the end after v: sum_w q(w | v) + e(v) = 1 gives e.
    ends = 1 / np.linalg.solve(np.eye(len(words)) - ratio, np.ones(len(words)))
    assert ((0 < ends) & (ends < 1)).all()
    assert p[0] + (one / ends).sum() == pytest.approx(1.0, abs=1e-4)


def test_scores_are_those_of_the_seats(spark, monkeypatch, tmp_path):
    """Totals of contexts are the sums of the seats of all groups, and scores follow from them."""
    monkeypatch.setattr(word_seats, "LEAST_GROUPS", 3)
    monkeypatch.setattr(word_seats, "scratch_path", lambda *_: str(tmp_path / "files"))
    rng = random.Random(7)
    words = [f"{a}{b}" for a in "river stone lamp garden".split() for b in ("", "s", "ation", "é")]
    texts = {i: " ".join(words[min(int(rng.expovariate(0.25)), 15)] for _ in range(rng.randrange(0, 40))) for i in range(200)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    rows, tokens = word_seats.score_all(frame, hpylm.BURN, hpylm.SAMPLES)
    rows = {r["doc_id"]: r["score"] for r in rows.collect()}
    folder = f"file://{tmp_path}/files"
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    split = lambda t: [*t.encode().lower().split(), hpylm.END]
    count = Counter((w, u) for i, t in texts.items() if not held(i) for u, w in zip([None, *split(t)], split(t)))
    assert tokens == sum(count.values())

    # Ids as documented.
    ids, places = {None: 0}, defaultdict(list)
    for w in {w for t in texts.values() for w in split(t)}:
        places[zlib.crc32(w) % 3, hpylm.context_of(w)].append(w)
    for (part, kind), members in places.items():
        ids.update({w: part << 30 | kind << 20 | k for k, w in enumerate(sorted(members))})
    named = {v: k for k, v in ids.items()}
    kind = lambda u: 0 if u is None else hpylm.context_of(u)

    def seats(number):
        """Customers and tables by level and dish, and by restaurant."""
        c, t = [Counter() for _ in range(4)], [Counter() for _ in range(4)]
        for part in range(3):
            group = word_seats._restored(folder, part, number)
            for k in range(len(group.word)):
                w, u = named[group.words[group.word[k]]], named[group.befores[group.before[k]]]
                c[0][w, u], t[0][w, u] = group.c[0][k], group.t[0][k]
            names = [[(named[group.words[w]], r) for w, r in zip(at, group.at[level])] for level, at in enumerate((group.up[2][group.up[1]], group.up[2], range(len(group.words))))]
            for level in range(3):
                for name, x, y in zip(names[level], group.c[level + 1], group.t[level + 1]):
                    c[level + 1][name], t[level + 1][name] = x, y
        for x, y in zip(c, t):
            assert all(min(1, x[k]) <= y[k] <= x[k] for k in x)
        for level, up in enumerate((kind, lambda r: r // hpylm.FINE, lambda r: 0)):  # tables are the parent's customers
            sums = Counter()
            for (w, r), y in t[level].items():
                sums[w, up(r)] += y
            assert +sums == +c[level + 1]
        return c, t

    def by_restaurant(x):
        out = Counter()
        for (_, r), y in x.items():
            out[r] += y
        return out

    start = seats(-1)[0]
    assert +Counter({k: int(v) for k, v in start[0].items()}) == count
    few = [[sum(v == k for v in c.values()) for k in (1, 2)] for c in start]
    d = [min(max((a + 0.5) / (a + 2 * b + 1), 0.05), 0.95) for a, b in few]
    kept, uniform = range(hpylm.BURN, hpylm.BURN + hpylm.SAMPLES), 1 / (len({w for w, _ in count}) + 1)
    samples = []
    for number in kept:
        c, t = seats(number)
        customers, tables = [by_restaurant(x) for x in c], [by_restaurant(x) for x in t]
        for at in range(3):  # what the groups of contexts were sent
            _, _, place, _, total, _ = word_seats._lists(folder, at)
            sums = word_seats.spread(word_seats._read(f"{folder}/tables{number}", str(at))[0])
            known = sorted(i for i in ids.values() if i >> 30 == at and (i in {ids[u] for _, u in c[0]}))
            assert [customers[0][named[i]] for i in known] == total.tolist() and [tables[0][named[i]] for i in known] == sums.tolist()
        samples.append((c, t, customers, tables))

    def p(w, u):
        found = []
        for c, t, customers, tables in samples:
            x = uniform
            for level, r in ((3, 0), (2, kind(u) // hpylm.FINE), (1, kind(u)), (0, u)):
                x = (c[level][w, r] - d[level] * t[level][w, r] + (1 + d[level] * tables[level][r]) * x) / (1 + customers[level][r])
            found.append(x)
        return np.mean(found)

    for i, text in texts.items():
        want = sum(math.log10(p(w, u)) for u, w in zip([None, *split(text)], split(text)))
        assert rows[i] == pytest.approx(want, abs=1e-4)


def test_gamma_is_drawn_from_its_law():
    keys = np.arange(200_000, dtype=np.uint64)
    for shape in (1.1, 2.5, 40.0):
        x = word_seats.gamma(np.full(len(keys), shape), keys, 11)
        assert x.mean() == pytest.approx(shape, rel=0.02) and x.var() == pytest.approx(shape, rel=0.03)
        assert (x < shape).mean() == pytest.approx(np.mean(np.random.default_rng(1).gamma(shape, size=200_000) < shape), abs=0.006)


@pytest.mark.parametrize("x", [[], [0], [0, 0, 5], [1, 1 << 40, 255, 256], list(range(1000))])
def test_packed_numbers(x):
    assert word_seats.spread(word_seats.squeeze(np.array(x, np.int64))).tolist() == x
    assert word_seats.risen(word_seats.rising(np.array(sorted(x), np.int64))).tolist() == sorted(x)

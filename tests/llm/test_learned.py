"""Quality, toxicity, language-model scores and nearest neighbours."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobsight.llm import hpylm, permutation_index as perm, quality, toxicity
from jobsight.llm.sample import labelled_sample

SF = "/root/testdata/sf0.01"


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def ranked(pairs):
    """Share of (good, bad) pairs in right order."""
    good, bad = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


@pytest.fixture(scope="module")
def labelled(spark):
    """Documents with junk and toxic sentences, and their labels; some labels are null or contradict."""
    rng = random.Random(9)
    words = [f"{a}{b}" for a in "stone river lamp window paper garden table music".split() for b in range(12)]
    insults = ["stupid", "idiot", "trash"]
    docs, labels = [], []
    for i in range(900):
        toxic, junk = i % 7 == 0, i % 5 == 0
        sentences = [[rng.choice(words) for _ in range(8)] for _ in range(rng.randrange(2, 9))]
        if toxic:
            rng.choice(sentences)[2:2] = rng.sample(insults, 2)
        if junk:
            sentences = [[w.upper() + "%%%" for w in s] for s in sentences]
        docs.append((i, ". ".join(" ".join(s) for s in sentences), "en", f"src{i % 3}", 1))
        labels.append((i, int(not junk), int(toxic)))
    labels += [(0, 0, 0), (1, None, None), (None, 1, 1), (5000, 1, 1)]
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels[1:900]})


def test_sample_is_bounded_and_leaves_out_held_rows(labelled):
    docs, labels, _ = labelled
    rows = labelled_sample(docs, labels, "toxic", 50).collect()
    assert len(rows) == 50 and all(crc(r["doc_id"], 3) != 1 and r["doc_id"] not in (0, 1) for r in rows)


def test_toxicity_learns(labelled):
    docs, labels, truth = labelled
    model = toxicity.train(docs, labels)
    rows = [r for r in toxicity.toxicity_scores(docs, model).collect() if r["doc_id"] in truth]
    held = [(truth[r["doc_id"]][1], r["score"]) for r in rows if r["held_out"]]
    assert all(r["held_out"] == (crc(r["doc_id"], 3) == 1) for r in rows)
    assert ranked(held) > 0.99
    assert sum((s >= 0.7) == bool(y) for y, s in held) >= 0.97 * len(held)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        assert r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1
        for s in r["sentences"]:  # sentences that were never labelled are located
            assert re.search("stupid|idiot|trash", texts[r["doc_id"]][s["start"]:s["end"]].lower())
    kept = {r["doc_id"] for r in toxicity.keep_clean(docs, model).collect()}
    assert kept == {r["doc_id"] for r in toxicity.toxicity_scores(docs, model).where("predicted = 0").collect()}


def test_stems_are_learned(spark):
    """A stem whose endings differ in every document is found by its first letters, the narrowest that holds."""
    rng = random.Random(3)
    ends = [f"{a}{b}" for a in "abcdefghijklmnop" for b in "rstuvw"]
    texts = [(i, f"good day to all of {rng.choice(ends)}. " + (f"some lowei{rng.choice(ends)} here" if i % 4 == 0 else f"some lowl{rng.choice(ends)} here")) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in texts], "doc_id long, toxic int"))
    assert model.score("some loweixyz thing") > 0.7 > 0.3 > model.score("some lowlxyz thing. lower lowest")
    assert "lowe*" not in model.weights and model.weights["lowei*"] > 1


def test_noisy_or():
    """A document's score is 1 - prod(1 - p) of its sentences, also without any known word."""
    model = toxicity.Model({"bad": 5.0, "fine": -1.0, "awfu*": 3.0}, -4.0)
    assert model.sentence("so awfully bad") == pytest.approx(1 / (1 + math.exp(-4)))
    for text in ("Bad day. fine fine! other\nwords", "nothing here. at all", "", "...", "bad"):
        p = [model.sentence(text[a:b]) for a, b in toxicity.sentences_of(text)]
        assert model.score(text) == pytest.approx(1 - math.prod(1 - x for x in p))


@pytest.mark.parametrize("rows,score", [([], 0.0), ([(1, 1)], 1.0), ([(1, 0)], 0.0)])
def test_toxicity_with_labels_of_one_kind(spark, docs, rows, score):
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    got = toxicity.toxicity_scores(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == docs.count() and {r["score"] for r in got} <= {score, 0.0}


def test_odd_texts(docs, labelled):
    """Nulls, blanks, one long word and repeated rows get a score; clashing columns don't matter."""
    _, labels, _ = labelled
    base = labelled[0]
    tox, gam = toxicity.train(base, labels), quality.train(base, labels)
    n = docs.count()
    for rows in (toxicity.toxicity_scores(docs, tox).collect(), quality.quality_scores(docs, gam).collect()):
        assert len(rows) == n and all(0 <= r["score"] <= 1 for r in rows)
        assert all(r["held_out"] is (r["doc_id"] is not None and crc(r["doc_id"], 3) == 1) for r in rows)
    assert toxicity.keep_clean(docs, tox).columns == docs.columns


def test_quality_learns(labelled):
    docs, labels, truth = labelled
    rows = [r for r in quality.quality_scores(docs, quality.train(docs, labels)).collect() if r["doc_id"] in truth]
    assert ranked([(truth[r["doc_id"]][0], r["score"]) for r in rows if r["held_out"]]) > 0.99
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_gam_finds_an_interaction():
    """The product of two features is in neither alone; only the pair table can learn it."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.fit_gam(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert ((model.score(x[3000:]) >= 0.5) == (y[3000:] > 0)).mean() > 0.85
    # The score is the sum of the tables, looked up row by row.
    b = model.bins(x[:50])
    z = [model.base + sum(model.tables[j][b[r, j]] for j in range(4))
         + sum(g[b[r, i] * quality.GRID // quality.BINS, b[r, j] * quality.GRID // quality.BINS] for (i, j), g in zip(model.pairs, model.grids))
         for r in range(50)]
    assert np.allclose(model.log_odds(x[:50]), z)


def test_quality_without_labels(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {round(r["score"], 6) for r in quality.quality_scores(docs, quality.train(docs, labels)).collect()} == {0.5}
    assert quality.quality_scores(empty, quality.train(empty, labels)).count() == 0


# ---- language-model scores ----------------------------------------------------------------

def toks(text):
    return [*(text or "").encode().lower().split(), hpylm.END]


def test_counts_and_base_scores(docs, doc_rows):
    got = hpylm.scored_documents(docs).collect()
    held = lambda i: i is not None and crc(i, 5) == 1
    counts = Counter(w for i, t in doc_rows if not held(i) for w in toks(t))
    total, types = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in doc_rows:
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (types + 1))) for w in toks(t))
        want[i, held(i), len(toks(t)), sum(counts[w] > 0 for w in toks(t)), total, round(base, 4)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_runs_and_batches_don_t_matter(docs, monkeypatch):
    """Scores are the same when a task sorts a few tokens at a time and holds few sums."""
    rows = lambda: sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 3)) for r in hpylm.scored_documents(docs).collect())
    whole = rows()
    for name, value in (("RUN", 500), ("RUN_DOCS", 3), ("ROWS", 7), ("OPEN", 2)):
        monkeypatch.setattr(hpylm, name, value)
    assert rows() == whole


@pytest.mark.parametrize("d", [0.5, 0.8])
@pytest.mark.parametrize("c,a", [(2, 0.1), (5, 0.5), (12, 3.0), (40, 0.02), (40, 30.0), (150, 0.7), (300, 6.0)])
def test_tables_are_drawn_from_their_law(c, a, d):
    """Against the weights by the recursion of seatings, tabulated (few customers) or not (many)."""
    logs = np.full(c + 1, -np.inf)
    logs[1] = 0.0
    for n in range(1, c):  # a customer joins n others: a new table, or one of t by its size less d
        with np.errstate(divide="ignore"):
            logs = np.logaddexp(np.r_[-np.inf, logs[:-1]], logs + np.log(np.maximum(n - np.arange(c + 1) * d, 0)))
    p = logs + np.arange(c + 1) * np.log(a)
    p = np.exp(p - p.max())
    p /= p.sum()
    drawn = hpylm.draw_tables(np.full(40_000, float(c)), np.full(40_000, a), np.random.default_rng(1).random(40_000), d)
    assert np.abs(np.bincount(drawn.astype(int), minlength=c + 1) / 40_000 - p).max() < (0.012 if c <= hpylm.EXACT else 0.03)


def test_large_counts_are_drawn():
    t = hpylm.draw_tables(np.array([1e9, 1e12, 3.0]), np.array([1e3, 1e5, 1e9]), np.array([0.5, 0.5, 0.5]), 0.5)
    assert t[0] == pytest.approx(2e3, rel=0.2) and 1 <= t[1] < 1e12 and t[2] == 3


def test_probabilities_of_a_context_sum_to_one(spark):
    """Over all words and the unknown one, for contexts with and without seats."""
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice("the of river stone a lamp".split()) for _ in range(30))) for i in range(60)]
    model = hpylm.train(spark.createDataFrame(texts, "doc_id long, text string"))
    words = [r["word"] for r in model.words.collect()]
    assert len(words) == model.types == 7
    # One text per word, after the same first word: the score of that place is a difference.
    first = [(-1, "river")] + [(k, f"river {w.decode()}" if w != hpylm.END else "river") for k, w in enumerate([*words, b"neverseen"])]
    rows = _places(spark, model, [t for _, t in first[1:]])
    assert sum(rows) == pytest.approx(1.0, abs=1e-4)


def _places(spark, model, texts):
    """Probability of the second token of each text, by scores of texts with and without what follows."""
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r["doc_id"]: r["score"] for r in hpylm.score_texts(frame, model).collect()}
    singles = spark.createDataFrame([(k, t.split()[1]) for k, t in enumerate(texts) if len(t.split()) > 1], "doc_id long, text string")
    start = {r["doc_id"]: r["score"] for r in hpylm.score_texts(singles, model).collect()}
    first = spark.createDataFrame([(0, "river")], "doc_id long, text string")
    river_end = hpylm.score_texts(first, model).first()["score"]
    back_off, coarse = np.array(model.back_off), np.array(model.back_off_coarse)
    table = {r["word"]: r for r in model.words.collect()}

    def prob(word, context):
        r = table.get(word)
        samples = len(model.unknown)
        root = np.frombuffer(r["p_root"], "<f4") if r else np.array(model.unknown)
        at = {c: k for k, c in enumerate(r["coarse"])} if r else {}
        up = coarse[:, context // hpylm.FINE] * root
        if context // hpylm.FINE in at:
            k = at[context // hpylm.FINE]
            up = np.frombuffer(r["p_coarse"], "<f4")[k * samples:(k + 1) * samples]
        cells = np.frombuffer(r["contexts"], "<u2").tolist() if r else []
        return np.frombuffer(r["p"], "<f4")[cells.index(context)] if context in cells else (back_off[:, context] * up).mean()

    out = []
    river = hpylm.context_of(b"river")
    for k, t in enumerate(texts):
        words = toks(t)
        expected, context = 0.0, 0
        for w in words:
            expected += math.log10(prob(w, context))
            context = hpylm.context_of(w) if w != hpylm.END else 0
        assert whole[k] == pytest.approx(expected, abs=1e-4)
        out.append(prob(words[1], river))
    del start, river_end
    return out


def test_beats_single_words(spark):
    """On held-out documents of the test tables the model is better than counts of single words."""
    rows = hpylm.scored_documents(spark.read.parquet(f"{SF}/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] for r in rows) > 0.95 * sum(r["base_score"] for r in rows)
    assert np.mean([r["score"] > r["base_score"] for r in rows]) > 0.95
    assert all(r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"])) for r in rows)


def test_lm_without_rows(spark, empty):
    assert hpylm.scored_documents(empty).count() == 0
    only_held = next(i for i in range(100) if crc(i, 5) == 1)
    rows = hpylm.scored_documents(spark.createDataFrame([(only_held, "a b")], "doc_id long, text string")).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows] == [(3, 0, 0, 0.0, 0.0)]


# ---- nearest neighbours -------------------------------------------------------------------

def brute(rows, k):
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            scored = sorted((-float(np.dot(v, w)), i) for i, w in rows if i != q)
            out[q] = [i for _, i in scored[:k]]
    return out


def test_exact_on_odd_vectors(spark):
    rng = np.random.default_rng(0)
    good = [(i, rng.normal(size=6).tolist()) for i in range(120)]
    good[40] = (40, good[20][1])  # equal vectors tie by id
    good[41] = (41, good[20][1])
    odd = [(200, None), (220, [0.0] * 6), (240, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (260, [float("nan")] * 6), (280, [float("inf")] * 6), (300, [1.0]), (None, [1.0] * 6), (320, [])]
    frame = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x")).withColumn("v", F.lit(1))
    rows = perm.usable(frame)
    found = defaultdict(list)
    for r in perm.nearest(rows, rows.where("vec_id % 20 = 0"), k=7).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r["vec_id"])
        assert r["rank"] == len(found[r["query_id"]])
    assert dict(found) == brute(good, 7)


def test_few_and_no_candidates(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5])], "vec_id long, embedding array<double>")
    rows = perm.usable(frame)
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in perm.nearest(rows, rows).orderBy("query_id").collect()] == [(0, 1, 20, 0.5), (20, 1, 0, 0.5)]
    assert perm.nearest(rows.limit(0), rows.limit(0)).count() == 0


def test_footrule_by_inverted_files():
    """The sums over postings order rows as the footrule distance computed directly."""
    rng = np.random.default_rng(3)
    rows, queries, pivots = (rng.normal(size=(n, 8)) for n in (300, 5, 20))
    k = 6
    mine, theirs = perm.ranks(rows, pivots, k), perm.ranks(queries, pivots, k)
    for q, found in zip(theirs, perm.shortlists(rows, queries, pivots, k, 40)):
        far = [sum(abs((r.tolist().index(p) if p in r else k) - at) for at, p in enumerate(q.tolist())) for r in mine]
        assert max(far[i] for i in found) <= sorted(far)[39]


def test_recall_of_the_index(spark):
    """Production parameters against the exact search over the test table."""
    vectors = perm.usable(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    asked = vectors.where("vec_id % 20 = 0")
    truth, got = ({(r["query_id"], r["vec_id"]) for r in f.collect()} for f in (
        perm.nearest(vectors, asked, share=1.0, least=1 << 30), perm.nearest(vectors, asked)))
    assert len(truth & got) / len(truth) > 0.95


@pytest.mark.parametrize("spread", [0.0, 0.5, 1.0])
def test_recall_over_full_blocks(spark, spread):
    """Two full blocks of vectors without structure, of one norm or of norms that differ widely, at production parameters."""
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(2 * perm.BLOCK - 600, 64))
    rows *= (np.exp(rng.normal(size=len(rows)) * spread) / np.linalg.norm(rows, axis=1))[:, None]
    frame = perm.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>"))
    asked = range(0, len(rows), 160)
    got = defaultdict(set)
    for r in perm.nearest(frame, frame.where("vec_id % 160 = 0")).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for i in asked:
        products = rows @ rows[i]
        products[i] = -np.inf
        hits += len(got[i] & set(np.argsort(-products)[:20].tolist()))
    assert hits / (20 * len(asked)) > 0.93


def test_repeated_queries(spark):
    """Repeated query rows are asked once; those that share an id with another vector are ranked each."""
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    rows += [rows[20], rows[20], (40, [rng.gauss(0, 1) for _ in range(8)])]
    frame = perm.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = defaultdict(list)
    for r in perm.nearest(frame, frame.where("vec_id % 20 = 0")).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], round(r["score"], 9)))
    for query in (0, 20, 40):
        want = []
        for vector in {tuple(v) for i, v in rows if i == query}:
            scores = sorted((-sum(x * y for x, y in zip(vector, v)), i) for i, v in rows if i != query)
            want += [(place, i, round(-s, 9)) for place, (s, i) in enumerate(scores[:20], 1)]
        assert sorted(found[query]) == sorted(want)


def test_recall_in_a_whole_block():
    """Vectors without any structure, the hardest case: a full block, of which an eighth is compared exactly."""
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(perm.BLOCK, 64))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    pivots, asked = rows[rng.permutation(len(rows))[:perm.PIVOTS]], rows[:60]
    most = max(perm.LEAST, int(perm.SHARE * len(rows)))
    best = np.argsort(-(asked @ rows.T), axis=1)[:, 1:21]
    found = perm.shortlists(rows, asked, pivots, perm.PREFIX, most)
    assert np.mean([np.isin(b, f).mean() for b, f in zip(best, found)]) > 0.9


def test_copies_in_a_full_block(spark):
    """A third of a full block are copies of one vector, far more than a shortlist: ties go by id."""
    rng = np.random.default_rng(7)
    rows = rng.normal(size=(perm.BLOCK, 16))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    copies = np.sort(rng.choice(perm.BLOCK, perm.BLOCK // 3, replace=False))
    rows[copies] = rows[copies[0]]
    frame = perm.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>"))
    pivots = perm.choose_pivots(frame)
    assert len(pivots) == len(np.unique(pivots, axis=0)) == perm.PIVOTS
    asked = copies[::100].tolist()
    found = defaultdict(list)
    for r in perm.nearest(frame, frame.where(F.col("vec_id").isin(asked))).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r["vec_id"])
    assert dict(found) == {i: [j for j in copies[:21].tolist() if j != i][:20] for i in asked}


def test_pivots_and_scores_of_equal_vectors(spark):
    """Copies in several blocks, some with repeated ids and some with other vectors of one id."""
    rng = np.random.default_rng(8)
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.normal(size=(90, 5)))]
    rows += [(i, rows[3][1]) for i in range(100, 160)] + [(3, rows[4][1]), (3, rows[3][1])]
    frame = perm.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    pivots = perm.choose_pivots(frame)
    assert {tuple(p) for p in pivots.tolist()} == {tuple(v) for _, v in rows} and len(pivots) == 90
    found = perm.nearest(frame, frame.where("vec_id = 120"), k=30, block=32, least=20).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [3, 3, *[i for i in range(100, 160) if i != 120]][:30]
    assert len({r["score"] for r in found}) == 1

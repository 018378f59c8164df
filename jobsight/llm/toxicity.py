"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence has the probability sigmoid(bias + sum of the weights of its distinct features); a
document is toxic if at least one sentence is: 1 - prod(1 - p) (noisy-or). The weights are
fitted to document labels only, by gradient descent on the likelihood of the bags; the
sentences' own labels are never known. A feature that is found almost only in toxic documents
starts at the log-odds that its documents show, less ``CAUTION`` spreads: toxic documents
mostly hold several such features, and from nothing the strongest alone would explain them
all. The fitted sentence scores then locate the offending sentences.

Words are lower-cased runs of letters; sentences end at . ! ? or a line break. Features are words
and, for stems with changing endings, the first ``STEMS`` letters of words. Only features
whose share among toxic documents of the sample differs clearly from that among the others
get a weight (at most ``VOCABULARY``; of a stem and a longer one found in as many documents the
longer), so the model is small and a text without any of them needs no more than its number
of sentences.

Edge cases: a null or empty text has one empty sentence and the lowest score; without labels,
or with labels of one kind only, every score is the share of toxic labels (0 without any);
repeated rows are scored each; an empty table gives an empty result; other columns are not
read (``toxicity_scores``) or kept (``keep_clean``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .sample import MODULUS, ROWS, labelled_sample
from .text import held_out, map_rows, whole_texts

THRESHOLD = 0.7
VOCABULARY = 1024
#: A feature needs so many documents of the sample.
LEAST_DOCS = 5
#: Lengths of stems, the shortest first.
STEMS = (4, 5, 6)
STEPS = 400
RATE = 0.05
#: Pull of the weights to where they start: per unit of the difference (for those that start
#: at 0, which makes them sparse) and per square.
L1, L2 = 2e-5, 1e-6
FIRST_BIAS = -9.0
#: Spreads by which the first weight of a feature stays below what its documents say.
CAUTION = 3.0

_LETTERS = re.compile(r"[^\W\d_]+")
_ENDS = re.compile(r"[.!?\n]+")


def words_of(text: str) -> set[str]:
    return set(_LETTERS.findall(text.lower()))


def features_of(words: set[str]) -> set[str]:
    """The words themselves and their stems, marked by a star."""
    return words | {f"{w[:k]}*" for w in words for k in STEMS if len(w) >= k}


def _head(feature: str) -> str:
    """The first letters that a word must have to hold a feature."""
    return feature.rstrip("*")[:STEMS[0]]


def sentences_of(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences with any content, at least one."""
    spans, start = [], 0
    for end in [*(m.start() for m in _ENDS.finditer(text)), len(text)]:
        begin = start
        while begin < end and text[begin] in ".!?\n":
            begin += 1
        if text[begin:end].strip():
            spans.append((begin, end))
        start = end
    return spans or [(0, len(text))]


@dataclass
class Model:
    """Feature weights and bias; ``prior`` is the answer where nothing could be learned."""

    weights: dict[str, float]
    bias: float
    prior: float | None = None

    def __post_init__(self) -> None:
        self._heads = {_head(f) for f in self.weights}

    def _weighed(self, text: str) -> set[str]:
        """Words of a text that can hold a weighed feature."""
        return {w for w in words_of(text) if w[:STEMS[0]] in self._heads}

    def _log_odds(self, text: str) -> float:
        found = self._weighed(text)
        return self.bias + (sum(self.weights.get(f, 0.0) for f in sorted(features_of(found))) if found else 0.0)

    def sentence(self, text: str) -> float:
        """Probability that a sentence is offending."""
        return float(1 / (1 + np.exp(-self._log_odds(text))))

    def score(self, text: str) -> float:
        """Probability that a document is toxic."""
        if self.prior is not None:
            return self.prior
        spans = sentences_of(text)
        if not self._weighed(text):
            return float(-np.expm1(-len(spans) * np.logaddexp(0.0, self.bias)))
        z = np.array([self._log_odds(text[a:b]) for a, b in spans])
        return float(-np.expm1(-np.logaddexp(0.0, z).sum()))

    def offending(self, text: str, least: float = 0.5) -> list[dict]:
        """(start, end, score) in characters of the sentences with a score of ``least`` or more."""
        found = [{"start": a, "end": b, "score": self.sentence(text[a:b])} for a, b in sentences_of(text)]
        return [s for s in found if s["score"] >= least]


def _vocabulary(sample: DataFrame) -> dict[str, tuple[int, int]]:
    """Features whose document shares differ most between toxic and other documents of the sample,
    with the numbers of toxic and other documents they are found in."""

    def per_batch(rows: list[dict]) -> list[dict]:
        seen: dict[str, list[int]] = {}
        for r in rows:
            for w in features_of(words_of(r["text"].decode())):
                seen.setdefault(w, [0, 0])[r["y"]] += 1
        return [{"word": w, "clean": a, "toxic": b} for w, (a, b) in seen.items()]

    counts = map_rows(sample, per_batch, "word string, clean long, toxic long").groupBy("word").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    docs = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share_t, share_c = (F.col("toxic") + 0.5) / (docs[1] + 1.0), (F.col("clean") + 0.5) / (docs[0] + 1.0)
    both = (F.col("toxic") + F.col("clean") + 1.0) / (docs[0] + docs[1] + 2.0)
    # Size of the difference of shares against its chance spread.
    z = F.abs(share_t - share_c) / F.sqrt(both * (1 - both) * (1.0 / docs[1] + 1.0 / docs[0]))
    kept = counts.where(F.col("toxic") + F.col("clean") >= LEAST_DOCS).withColumn("z", z).where("z > 4")
    best = kept.orderBy(F.col("z").desc(), "word").limit(4 * VOCABULARY).collect()
    # A stem that says no more than a longer one, or than a word, is left out: the narrower one stays.
    found = {r["word"]: (r["toxic"], r["clean"]) for r in best}
    wider = set()
    for word, seen in found.items():
        stem = word.rstrip("*")
        shorter = [f"{stem[:k]}*" for k in STEMS if k < len(stem) or (k == len(stem) and word == stem)]
        wider.update(s for s in shorter if found.get(s) == seen)
    return {r["word"]: found[r["word"]] for r in [r for r in best if r["word"] not in wider][:VOCABULARY]}


def _bags(sample: DataFrame, vocabulary: list[str]) -> list[dict]:
    """Per document of the sample: y, its sentences without features, and the features of the others."""
    index = {w: i for i, w in enumerate(vocabulary)}
    heads = {_head(f) for f in vocabulary}

    def held_by(text: str) -> list[int]:
        words = {w for w in words_of(text) if w[:STEMS[0]] in heads}
        return sorted({index[f] for f in features_of(words) if f in index}) if words else []

    def per_batch(rows: list[dict]) -> list[dict]:
        out = []
        for r in rows:
            text = r["text"].decode()
            found = [held_by(text[a:b]) for a, b in sentences_of(text)]
            held = [f for f in found if f]
            out.append({"y": r["y"], "plain": len(found) - len(held), "features": [i for f in held for i in f], "sizes": [len(f) for f in held]})
        return out

    schema = "y int, plain long, features array<int>, sizes array<int>"
    return map_rows(sample, per_batch, schema).toArrow().to_pylist()


def fit(sample: DataFrame, steps: int = STEPS) -> Model:
    """Fit the model to a bounded sample (doc_id, text, y)."""
    shares = sample.agg(F.avg("y")).first()[0]
    if shares is None or shares in (0.0, 1.0):
        return Model({}, 0.0, float(shares or 0.0))
    counts = _vocabulary(sample)
    vocabulary = list(counts)
    bags = _bags(sample, vocabulary)
    bags.sort(key=lambda b: (b["y"], b["plain"], b["features"], b["sizes"]))
    y = np.array([b["y"] for b in bags], float)
    plain = np.array([b["plain"] for b in bags], float)
    sizes = np.array([s for b in bags for s in b["sizes"]], int)
    features = np.array([i for b in bags for i in b["features"]], int)
    of_doc = np.repeat(np.arange(len(bags)), [len(b["sizes"]) for b in bags])  # document of a sentence
    of_sentence = np.repeat(np.arange(len(sizes)), sizes)  # sentence of a feature
    toxic, clean = np.array(list(counts.values()), float).reshape(-1, 2).T + 0.5
    sure = np.log(toxic / clean) - CAUTION * np.sqrt(1 / toxic + 1 / clean)
    start = np.where(sure > 0, sure - FIRST_BIAS, 0.0)
    w = np.append(start, FIRST_BIAS)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = w[-1] + np.bincount(of_sentence, w[features], len(sizes))
        total = np.bincount(of_doc, np.logaddexp(0, z), len(bags)) + plain * np.logaddexp(0, w[-1])
        # Loss of a bag: total if clean, -log(1 - exp(-total)) if toxic.
        pull = np.where(y > 0, -1 / np.expm1(np.clip(total, 1e-9, 500)), 1.0) / len(bags)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-w[-1]))
        dz = p * pull[of_doc]
        grad = np.empty_like(w)
        grad[:-1] = np.bincount(features, dz[of_sentence], len(vocabulary)) + L1 * np.sign(w[:-1]) * (start == 0) + L2 * (w[:-1] - start)
        grad[-1] = dz.sum() + (plain * pull).sum() * p0
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    kept = {v: float(x) for v, x in zip(vocabulary, w) if abs(x) >= 0.05}
    return Model(kept, float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents that are not held out."""
    return fit(labelled_sample(docs, labels, "toxic", rows))


def toxicity_scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, and the offending
    sentences of documents predicted toxic as (start, end, score)."""

    def per_batch(rows: list[dict]) -> list[dict]:
        out = []
        for r in rows:
            text = r["text"].decode()
            score = model.score(text)
            toxic = score >= threshold
            out.append({"doc_id": r["doc_id"], "score": score, "predicted": int(toxic), "sentences": model.offending(text) if toxic else []})
        return out

    schema = "doc_id long, score double, predicted int, sentences array<struct<start:int,end:int,score:double>>"
    scored = map_rows(whole_texts(docs), per_batch, schema)
    return scored.select("doc_id", held_out(F.col("doc_id"), MODULUS).alias("held_out"), "score", "predicted", "sentences")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns kept. Scored in place: a row
    passes the task with its text, so no join is needed."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            keep = [model.score(t.as_py() or "") < threshold for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

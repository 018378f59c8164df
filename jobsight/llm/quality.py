"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text falls into one of ``BINS`` bins and has a lookup table of log-odds;
chosen pairs of features have a table over a coarse grid. The tables are learned by cyclic
boosting: round after round, each feature in turn gets a shallow tree (two levels of splits
of its own bins, Newton steps) added to its table with a small learning rate, so that no feature
takes what another explains. The pairs that explain most of what is left are then boosted in
the same way. Scoring is one lookup and addition per table, for all rows of a batch at once.

The sample for fitting is bounded (``sample.ROWS``) and brought to the driver as numbers:
rows x features doubles. A sixth of it stops the boosting early.

Edge cases: a null or empty text has all features 0 and a score like any other; without
labels, or with labels of one kind only, every score is the share of good labels (0.5
without any); repeated rows are scored each; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .sample import MODULUS, ROWS, labelled_sample
from .text import held_out, map_rows, whole_texts

THRESHOLD = 0.5
BINS, GRID = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 150, 40, 6
RATE = 0.1
#: Weight of the pull of a leaf to 0, and rows that a leaf needs.
RIDGE, LEAST_ROWS = 1.0, 10
PATIENCE = 20

FEATURES = (
    "log_words", "mean_word", "long_words", "distinct_words", "top_word", "upper", "digits", "marks", "marks_in_words",
    "stops", "lines", "line_words", "repeated_lines", "entropy", "non_ascii", "bare_marks", "repeated_pairs",
)
_LETTER_MARK = re.compile(rb"[A-Za-z][^A-Za-z0-9\s\x80-\xff]{2,}")


def features_of(text: bytes) -> list[float]:
    """The numbers of ``FEATURES`` for a whole text; shares are of bytes, words or lines."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, counts = len(words), np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    inked = max(1, int(counts[33:].sum()))
    upper, lower, digits = int(counts[65:91].sum()), int(counts[97:123].sum()), int(counts[48:58].sum())
    wide = int(counts[128:].sum())
    marks = inked - upper - lower - digits - wide
    distinct: dict[bytes, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = counts[33:][counts[33:] > 0] / inked
    return [
        float(np.log1p(n)), inked / n, sum(len(w) > 12 for w in words) / n, len(distinct) / n, max(distinct.values()) / n,
        upper / inked, digits / inked, marks / inked, len(_LETTER_MARK.findall(text)) / n,
        int(counts[33] + counts[46] + counts[63]) / n, len(lines) / n, float(np.log1p(n / len(lines))),
        1 - len(set(lines)) / len(lines), float(-(share * np.log2(share)).sum()), wide / inked,
        sum(c for w, c in distinct.items() if not w[:1].isalnum() and w[0] < 128) / n,
        1 - len(set(zip(words, words[1:]))) / max(1, n - 1) if n > 1 else 0.0,
    ]


@dataclass
class Gam:
    """Bin edges per feature and tables of log-odds per feature and per pair."""

    edges: list[np.ndarray]
    base: float
    tables: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of rows of features: one lookup per table."""
        z = np.full(len(x), self.base)
        if not len(self.tables) or not len(x):
            return z
        b = self.bins(x)
        for j, table in enumerate(self.tables):
            z += table[b[:, j]]
        for (i, j), grid in zip(self.pairs, self.grids):
            z += grid[b[:, i] * GRID // BINS, b[:, j] * GRID // BINS]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Best split of bins into left [:k] and right [k:]: (gain, k); k is 0 if none is allowed."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h, left_n = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    right_g, right_h, right_n = g.sum() - left_g, h.sum() - left_h, n.sum() - left_n
    gain = _gain(left_g, left_h) + _gain(right_g, right_h) - _gain(g.sum(), h.sum())
    gain = np.where((left_n >= LEAST_ROWS) & (right_n >= LEAST_ROWS), gain, 0.0)
    k = int(gain.argmax())
    return (float(gain[k]), k + 1) if gain[k] > 1e-12 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Steps per bin of a tree of two levels."""
    _, k = _cut(g, h, n)
    edges = [0, len(g)] if not k else sorted({0, _cut(g[:k], h[:k], n[:k])[1], k, k + _cut(g[k:], h[k:], n[k:])[1], len(g)})
    step = np.zeros(len(g))
    for a, b in zip(edges, edges[1:]):
        step[a:b] = -g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return step


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, steps) of a tree over a grid: a split of the first feature and one of the second on each side."""
    best, steps = 0.0, np.zeros_like(g)
    for k in range(1, len(g)):
        gain, cuts = 0.0, []
        for side in (slice(0, k), slice(k, len(g))):
            got, c = _cut(g[side].sum(0), h[side].sum(0), n[side].sum(0))
            gain += got
            cuts.append((side, c))
        if gain > best:
            best, steps = gain, np.zeros_like(g)
            for side, c in cuts:
                for part in (slice(0, c), slice(c, g.shape[1])):
                    steps[side, part] = -g[side, part].sum() / (h[side, part].sum() + RIDGE)
    return best, steps


def fit_gam(x: np.ndarray, y: np.ndarray) -> Gam:
    """Fit on rows of features and labels 0 or 1 (numbers of a bounded sample)."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    model = Gam(edges, base, np.zeros((x.shape[1], BINS)))
    b = model.bins(x)
    check = np.arange(len(y)) % 6 == 5  # rows that stop the boosting
    fit = ~check
    z = np.full(len(y), base)

    def loss() -> float:
        return float(np.logaddexp(0, np.where(y[check] > 0, -z[check], z[check])).mean()) if check.any() else 0.0

    def sums(cell: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z[fit]))
        c = cell[fit]
        return np.bincount(c, p - y[fit], size), np.bincount(c, p * (1 - p), size), np.bincount(c, minlength=size)

    def boost(rounds: int, one_round, state) -> None:
        """Rounds until the check rows get no better; the best state is kept."""
        nonlocal z
        best, kept, since = loss(), ([s.copy() for s in state], z.copy()), 0
        for _ in range(rounds):
            one_round()
            now = loss()
            if now < best - 1e-6:
                best, kept, since = now, ([s.copy() for s in state], z.copy()), 0
            else:
                since += 1
                if since >= PATIENCE:
                    break
        for s, k in zip(state, kept[0]):
            s[...] = k
        z = kept[1]

    def main_round() -> None:
        for j in range(x.shape[1]):
            step = RATE * _tree(*sums(b[:, j], BINS))
            model.tables[j] += step
            z[:] += step[b[:, j]]

    boost(ROUNDS, main_round, [model.tables])
    coarse = b * GRID // BINS
    cells = {(i, j): coarse[:, i] * GRID + coarse[:, j] for i, j in combinations(range(x.shape[1]), 2)}
    shaped = lambda c: [s.reshape(GRID, GRID) for s in sums(c, GRID * GRID)]
    ranked = sorted(cells, key=lambda p: (-_pair_tree(*shaped(cells[p]))[0], p))
    model.pairs = ranked[:PAIRS]
    model.grids = [np.zeros((GRID, GRID)) for _ in model.pairs]

    def pair_round() -> None:
        for pair, grid in zip(model.pairs, model.grids):
            _, step = _pair_tree(*shaped(cells[pair]))
            grid += RATE * step
            z[:] += RATE * step.reshape(-1)[cells[pair]]

    boost(PAIR_ROUNDS, pair_round, model.grids)
    return model


def _measured(texts: DataFrame, *more: str) -> DataFrame:
    kinds = {"doc_id": "long", "y": "int"}
    schema = ", ".join(f"{c} {kinds[c]}" for c in more) + ", x array<double>"
    return map_rows(texts, lambda rows: [{**{c: r[c] for c in more}, "x": features_of(r["text"])} for r in rows], schema)


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Gam:
    """Fit on at most ``rows`` labelled documents that are not held out."""
    sample = _measured(labelled_sample(docs, labels, "quality", rows), "doc_id", "y").toArrow().to_pylist()
    sample.sort(key=lambda r: (r["doc_id"], r["x"]))
    y = np.array([r["y"] for r in sample], float)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        return Gam([], float(np.log(share / (1 - share))))
    order = np.random.default_rng(3).permutation(len(y))
    return fit_gam(np.array([r["x"] for r in sample])[order], y[order])


def quality_scores(docs: DataFrame, model: Gam, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""

    def per_batch(rows: list[dict]) -> list[dict]:
        scores = model.score(np.array([features_of(r["text"]) for r in rows])).tolist()
        return [{"doc_id": r["doc_id"], "score": s, "predicted": int(s >= threshold)} for r, s in zip(rows, scores)]

    scored = map_rows(whole_texts(docs), per_batch, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id"), MODULUS).alias("held_out"), "score", "predicted")

"""Language-model scores by a hierarchical Pitman-Yor model.

Tokens are the words of a text, lower-cased in A-Z, and one end token. A token is a customer in
the restaurant of its context; a restaurant's tables are customers of its parent:

    context (class of the word before)  ->  coarse context  ->  root  ->  uniform over words

The context of a token in this module is a class of the word before it, made from its last bytes
(``COARSE * FINE`` classes; the start of a text is one of its own), so the number of
restaurants is fixed while the dishes are all words of the corpus. ``scored_documents`` seats by
the words before themselves, a level below the classes (``word_seats``).

**Seating by Gibbs.** Given one auxiliary gamma variable z per restaurant, the numbers of tables t
of its dishes are independent. For a dish with c customers and the discount d of its level

    p(t | c) ~ S(c, t) * (d * z * P_parent(word))^t        z | T ~ Gamma(strength / d + T)

where S counts seatings (generalised Stirling numbers: S(c + 1, t) = S(c, t - 1) + (c - t d) S(c, t))
and T is the number of all tables of the restaurant. Up to ``EXACT`` customers S is tabulated;
beyond, the ratio S(c, t + 1) / S(c, t) is taken at the saddle point of its generating function
(for d = 1/2 that differs from the closed form by less than 1 / c). Discounts are n1 / (n1 + 2 n2)
from all dishes of a level with one and two customers.
A sweep draws t of every (context, word), then of every (coarse context, word), then of every
word, then the z. All cells of a word lie in one row, and only the T and z of the restaurants,
a table of fixed size, pass through the driver. ``P_parent`` is that of the sweep before.
Random numbers are hashes of (word, context, sweep), so a sweep needs no stored state: a task
derives the tables again from the counts and the z of the earlier sweeps, and a lost executor
changes nothing. The first ``BURN`` sweeps are dropped; the predictive probabilities of the
later ones are averaged.

**Scoring.** Every task lists its tokens by word, as (document, context); these rows are joined
to the word's probabilities by an equi-join, and the sums go back to the documents. A frequent
word has one row per ``RUN`` tokens, which AQE can split over tasks.

Edge cases: a null or empty text is the end token alone; a null id takes part in learning and
is not held out; repeated rows are scored each; without training texts every token has the
probability 1; an empty table gives an empty result; other columns are not read. Memory grows
with ``RUN`` and the longest text (about 30 bytes per word of it).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from jobsight.session import stage

from .text import arrow_schema, held_out, pieces, whole_texts

MODULUS = 5
END = b"\n"  # no word: words hold no white space
COARSE, FINE = 32, 32
STRENGTH = 1.0
#: Customers of a dish up to which seatings are tabulated.
EXACT = 64
BURN, SAMPLES = 2, 2
SEED = 5
#: Tokens that a task sorts at a time, and documents in them (their number is stored in 16 bits).
RUN, RUN_DOCS = 4_000_000, 60_000
#: Rows of an Arrow batch, and runs whose sums a task holds.
ROWS, OPEN = 20_000, 64


def context_of(word: bytes) -> int:
    """Class of a word as the context of the next; its coarse class is this // FINE; 0 is the start of a text."""
    return (1 + word[-1] % (COARSE - 1)) * FINE + zlib.crc32(word[-4:]) % FINE


# ---- packed columns -----------------------------------------------------------------------

def _packed(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary column whose row i holds values[starts[i]:starts[i + 1]]."""
    ends = np.append(starts, len(values)).astype(np.int64) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer(values.tobytes())])


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(all values, number per row) of a binary column; null rows have none."""
    if not len(column):
        return np.empty(0, kind), np.empty(0, np.int64)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, "<i4")[column.offset:column.offset + len(column) + 1]
    raw = bytes(memoryview(data)[ends[0]:ends[-1]]) if data is not None else b""
    return np.frombuffer(raw, kind), np.diff(ends) // np.dtype(kind).itemsize


# ---- tokens of a task ---------------------------------------------------------------------

class _Numbers(dict):
    """Words to numbers, in order of their first use, with their contexts."""

    def __init__(self) -> None:
        super().__init__({END: 0})
        self.contexts = [0]

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.contexts.append(context_of(word))
        return number


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, list]]:
    """(words, word number, context and document of each token, ids of the documents), a run at a time."""
    numbers, tokens, ids, n = _Numbers(), [], [], 0

    def run():
        word, size = np.concatenate(tokens), np.array([len(t) for t in tokens])
        before = np.empty(len(word), np.uint16)
        before[1:] = np.array(numbers.contexts, np.uint16)[word[:-1]]
        before[np.cumsum(size) - size] = 0
        return list(numbers), word, before, np.repeat(np.arange(len(size), dtype=np.uint32), size), ids

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            get = numbers.__getitem__
            own = [np.fromiter(map(get, p.split()), np.int32) for p in pieces(text.as_py().lower())]
            tokens.append(np.concatenate([*own, np.zeros(1, np.int32)]))
            ids.append(doc_id)
            n += len(tokens[-1])
            if n >= RUN or len(ids) >= RUN_DOCS:
                yield run()
                numbers, tokens, ids, n = _Numbers(), [], [], 0
    if ids:
        yield run()


def _groups(key: np.ndarray) -> np.ndarray:
    """Places where a sorted key changes, the first included."""
    return np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]]) if len(key) else np.empty(0, int)


# ---- counts -------------------------------------------------------------------------------

COUNTS = "word binary, n long, contexts binary, counts binary"


def _merge(words: pa.Array, contexts: pa.Array, counts: pa.Array) -> pa.RecordBatch:
    """One row per word from rows in order of their words."""
    code = words.dictionary_encode()
    of_row = code.indices.to_numpy().astype(np.int64)
    context, size = _flat(contexts, "<u2")
    count, _ = _flat(counts, "<u8")
    key, place = np.unique(np.repeat(of_row, size) << 16 | context, return_inverse=True)
    total = np.zeros(len(key), "<u8")
    np.add.at(total, place, count)
    starts = _groups(key >> 16)
    n = np.add.reduceat(total, starts).astype(np.int64) if len(starts) else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [code.dictionary, pa.array(n), _packed((key & 0xFFFF).astype("<u2"), starts), _packed(total, starts)],
        schema=pa.schema([("word", pa.binary()), ("n", pa.int64()), ("contexts", pa.binary()), ("counts", pa.binary())]),
    )


def count_cells(docs: DataFrame) -> DataFrame:
    """Per word of the texts: its count n and, packed, the contexts it is found in with their counts."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, word, context, _, _ in _runs(batches):
            key, n = np.unique(word.astype(np.int64) << 16 | context, return_counts=True)
            starts = _groups(key >> 16)
            names, ends = (key[starts] >> 16).tolist(), np.append(starts, len(key))
            for a in range(0, len(starts), ROWS):
                b = min(a + ROWS, len(starts))
                part, at = slice(ends[a], ends[b]), starts[a:b] - ends[a]
                yield pa.RecordBatch.from_arrays([
                    pa.array([words[i] for i in names[a:b]], pa.binary()), pa.array(np.add.reduceat(n[part], at)),
                    _packed((key[part] & 0xFFFF).astype("<u2"), at), _packed(n[part].astype("<u8"), at),
                ], names=["word", "n", "contexts", "counts"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([b for b in (held, batch) if b is not None]).combine_chunks().to_batches()[0] if batch.num_rows else None
            if rows is None:
                continue
            out = _merge(rows.column(0), rows.column(2), rows.column(3))
            held = out.slice(out.num_rows - 1)  # the last word may go on in the next batch
            yield out.slice(0, out.num_rows - 1)
        if held is not None:
            yield held

    rows = whole_texts(docs).mapInArrow(local, COUNTS)
    return rows.repartition("word").sortWithinPartitions("word").mapInArrow(merged, COUNTS)


# ---- seating ------------------------------------------------------------------------------

@dataclass
class Totals:
    """Per level (contexts, coarse contexts, root): customers, tables and z of every restaurant, and the discount."""

    customers: list[np.ndarray]
    tables: list[np.ndarray]
    z: list[np.ndarray]
    discount: list[float]
    uniform: float

    def back_off(self, level: int) -> np.ndarray:
        """Mass that a restaurant leaves to its parent."""
        return (STRENGTH + self.discount[level] * self.tables[level]) / (STRENGTH + self.customers[level])


def _random(key: np.ndarray, seed: int) -> np.ndarray:
    """Uniform numbers in (0, 1) that depend on 64-bit keys and a seed only."""
    with np.errstate(over="ignore"):
        x = key + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


class Seatings:
    """Ratios S(c, t + 1) / S(c, t) for one discount."""

    def __init__(self, discount: float) -> None:
        self.discount = d = discount
        # log S for c up to EXACT, by the recursion.
        self.logs = np.full((EXACT + 1, EXACT + 1), -np.inf)
        self.logs[1, 1] = 0.0
        t = np.arange(EXACT + 1)
        for c in range(1, EXACT):
            with np.errstate(divide="ignore"):
                stay = np.log(np.maximum(c - t * d, 0)) + self.logs[c]
            self.logs[c + 1] = np.logaddexp(np.r_[-np.inf, self.logs[c][:-1]], stay)
        # Saddle point y as a function of c / t, tabulated on a grid of y.
        y = np.exp(np.linspace(np.log(1e-12), np.log(1 - 1e-9), 4000))
        ratio = np.log(d) + (1 - 1 / d) * np.log(y) + np.log(-np.expm1(np.log(y) / d)) - np.log1p(-y)
        self._ratio, self._y = ratio[::-1], np.log(y)[::-1]

    def log_rise(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """log S(c, t + 1) - log S(c, t) for large c and 1 <= t < c."""
        y = np.exp(np.interp(np.log(c / t), self._ratio, self._y))
        return np.log1p(-y) - np.log(self.discount * t)


_SEATINGS: dict[float, Seatings] = {}


def draw_tables(c: np.ndarray, a: np.ndarray, u: np.ndarray, discount: float) -> np.ndarray:
    """Numbers of tables of c customers each, by inverting p(t) ~ S(c, t) a^t at u."""
    if discount not in _SEATINGS:
        _SEATINGS.clear()
        _SEATINGS[discount] = Seatings(discount)
    seatings, t = _SEATINGS[discount], np.ones(len(c))
    a = np.log(np.maximum(a, 1e-300))

    def invert(rows: np.ndarray, low: np.ndarray, logs: np.ndarray) -> None:
        p = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
        t[rows] = np.minimum(low + (p < u[rows, None] * p[:, -1:]).sum(axis=1), c[rows])

    def blocks(rows: np.ndarray, wide: int) -> Iterator[np.ndarray]:
        size = max(1, (1 << 20) // wide)
        return (rows[i:i + size] for i in range(0, len(rows), size))

    small = np.flatnonzero((c > 1) & (c <= EXACT))
    step = np.ceil(np.log2(c[small])).astype(int)
    for s in np.unique(step).tolist():
        wide = min(1 << s, EXACT)
        for rows in blocks(small[step == s], wide):
            invert(rows, np.ones(len(rows)), seatings.logs[c[rows].astype(int), 1:wide + 1] + a[rows, None] * np.arange(1, wide + 1))
    # Large counts: p rises to one mode and falls, so a window of 10 spreads around it holds it all.
    large = np.flatnonzero(c > EXACT)
    if len(large):
        n, low, high = c[large], np.ones(len(large)), c[large] - 1
        for _ in range(60):  # the last t before which p still rises
            mid = np.floor((low + high) / 2)
            rises = seatings.log_rise(n, mid) + a[large] > 0
            low, high = np.where(rises, np.minimum(mid + 1, n - 1), low), np.where(rises, high, np.maximum(mid, low))
            if (low >= high).all():
                break
        spread = np.sqrt(low) + 2
        start, end = np.maximum(1, np.floor(low - 10 * spread)), np.minimum(n, np.ceil(low + 10 * spread))
        step = np.ceil(np.log2(end - start + 1)).astype(int)
        for s in np.unique(step).tolist():
            for at in blocks(np.flatnonzero(step == s), 1 << s):
                now = start[at, None] + np.arange((1 << s) - 1)
                inside = now < n[at, None]
                rise = np.where(inside, seatings.log_rise(n[at, None], np.where(inside, now, 1.0)) + a[large[at], None], -np.inf)
                invert(large[at], start[at], np.concatenate([np.zeros((len(at), 1)), np.cumsum(rise, axis=1)], axis=1))
    return t


class Seating:
    """Cells of some words, and their tables after any number of sweeps."""

    def __init__(self, words: list[bytes], contexts: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> None:
        self.context = contexts.astype(np.int64)
        self.word = np.repeat(np.arange(len(words)), sizes)
        # Cells are sorted by word and context, so coarse cells are runs of them.
        coarse_key = self.word * COARSE + self.context // FINE
        first = np.r_[np.ones(min(1, len(coarse_key)), bool), coarse_key[1:] != coarse_key[:-1]]
        starts = np.flatnonzero(first)
        self.up = np.cumsum(first) - 1  # coarse cell of a cell
        self.coarse = (coarse_key[starts] % COARSE) if len(starts) else np.empty(0, np.int64)
        self.coarse_word = self.word[starts]
        named = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64)
        mixed = lambda w, c: named[w] ^ (c.astype(np.uint64) << np.uint64(40))
        self.c = [counts.astype(np.float64), None, None]
        # A customer alone has one table whatever is drawn, so only the other cells are drawn.
        self._many = np.flatnonzero(counts > 1)
        self._keys = [mixed(self.word[self._many], self.context[self._many]), mixed(self.coarse_word, self.coarse + COARSE * FINE), named]
        self.t = [np.ones(len(self.context)), np.ones(len(self.coarse)), np.ones(len(words))]
        self._climb()

    def _climb(self) -> None:
        self.c[1] = np.bincount(self.up, self.t[0], len(self.coarse))
        self.c[2] = np.bincount(self.coarse_word, self.t[1], len(self.t[2]))

    def _own(self, g: Totals, level: int, at: np.ndarray | int) -> np.ndarray:
        return (self.c[level] - g.discount[level] * self.t[level]) / (STRENGTH + g.customers[level][at])

    def _parents(self, g: Totals) -> tuple[np.ndarray, np.ndarray]:
        """Predictive probabilities of every coarse cell and word."""
        root = self._own(g, 2, 0) + g.back_off(2)[0] * g.uniform
        return self._own(g, 1, self.coarse) + g.back_off(1)[self.coarse] * root[self.coarse_word], root

    def probabilities(self, g: Totals) -> list[np.ndarray]:
        """Predictive probabilities of every cell, coarse cell and word."""
        coarse, root = self._parents(g)
        return [self._own(g, 0, self.context) + g.back_off(0)[self.context] * coarse[self.up], coarse, root]

    def sweep(self, g: Totals, number: int) -> None:
        """Draw all tables again, given the totals and z of the sweep before."""
        coarse, root = self._parents(g)
        d, some = g.discount, self._many
        draw = lambda level, c, a, keys: draw_tables(c, d[level] * a, _random(keys, 3 * number + level), d[level])
        self.t[0][some] = draw(0, self.c[0][some], g.z[0][self.context[some]] * coarse[self.up[some]], self._keys[0])
        self.c[1] = np.bincount(self.up, self.t[0], len(self.coarse))
        some = np.flatnonzero(self.c[1] > 1)
        self.t[1] = np.ones(len(self.coarse))
        self.t[1][some] = draw(1, self.c[1][some], g.z[1][self.coarse[some]] * root[self.coarse_word[some]], self._keys[1][some])
        self.c[2] = np.bincount(self.coarse_word, self.t[1], len(self.t[2]))
        self.t[2] = draw(2, self.c[2], np.full(len(self.t[2]), g.z[2][0] * g.uniform), self._keys[2])


def _seating(batch: pa.RecordBatch) -> Seating:
    contexts, sizes = _flat(batch.column(2), "<u2")
    return Seating(batch.column(0).to_pylist(), contexts, _flat(batch.column(3), "<u8")[0], sizes)


def _totals(cells: DataFrame, past: list[Totals], uniform: float) -> Totals:
    """Totals of all restaurants after as many sweeps as ``past`` is long, with new z."""
    sizes = [COARSE * FINE, COARSE, 1]
    all_sizes = [*sizes, 6]  # and dishes with one and two customers, per level

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, customers, few = [np.zeros(s) for s in sizes], [np.zeros(s) for s in sizes], np.zeros(6)
        for batch in batches:
            seats = _seating(batch)
            for k, g in enumerate(past):
                seats.sweep(g, k)
            for level, at in enumerate((seats.context, seats.coarse, np.zeros(len(seats.t[2]), int))):
                tables[level] += np.bincount(at, seats.t[level], sizes[level])
                if level or not past:  # the customers of contexts are the tokens, in every sweep
                    customers[level] += np.bincount(at, seats.c[level], sizes[level])
            if not past:
                few += [np.count_nonzero(c == k) for c in seats.c for k in (1, 2)]
        t, c = np.concatenate([*tables, few]), np.concatenate([*customers, few])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(t))), pa.array(t), pa.array(c)], names=["at", "t", "c"])

    rows = cells.mapInArrow(sums, "at long, t double, c double").groupBy("at").agg(F.sum("t"), F.sum("c")).collect()
    total = np.zeros((2, sum(all_sizes)))
    for at, t, c in rows:
        total[:, at] = t, c
    cut = np.cumsum(all_sizes)[:-1]
    *tables, few = np.split(total[0], cut)
    *customers, _ = np.split(total[1], cut)
    customers[0] = past[0].customers[0] if past else customers[0]
    discount = past[0].discount if past else [float(np.clip((one + 0.5) / (one + 2 * two + 1), 0.05, 0.95)) for one, two in few.reshape(3, 2)]
    rng = np.random.default_rng([SEED, len(past)])
    return Totals(customers, tables, [rng.gamma(STRENGTH / d + t) for d, t in zip(discount, tables)], discount, uniform)


# ---- model --------------------------------------------------------------------------------

MODEL = "word binary, n long, contexts binary, p binary, coarse binary, p_coarse binary, p_root binary"


@dataclass
class Model:
    """``words``: probabilities per word; the rest is small: back-off masses and the uniform per sample."""

    words: DataFrame
    tokens: int
    types: int
    back_off: list[np.ndarray]
    back_off_coarse: list[np.ndarray]
    unknown: list[float]


def train(docs: DataFrame, burn: int = BURN, samples: int = SAMPLES) -> Model:
    """Fit on all texts of ``docs``."""
    cells = stage(count_cells(docs), "hpy_counts")
    types, tokens = cells.agg(F.count(F.lit(1)), F.sum("n")).first()
    uniform = 1.0 / (types + 1)
    past: list[Totals] = []
    for _ in range(burn + samples + 1):
        past.append(_totals(cells, past, uniform))
    kept = past[burn + 1:]  # totals after the sweeps whose probabilities are averaged

    def probabilities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            seats, found = _seating(batch), []
            for k, g in enumerate(past[:-1]):
                seats.sweep(g, k)
                if k >= burn:
                    found.append(seats.probabilities(past[k + 1]))
            at, at_coarse = _groups(seats.word), _groups(seats.coarse_word)
            per_sample = lambda level: np.stack([f[level] for f in found], axis=1).astype("<f4")
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), batch.column(2), _packed(per_sample(0).mean(axis=1, dtype=np.float64).astype("<f4"), at),
                _packed(seats.coarse.astype("u1"), at_coarse), _packed_rows(per_sample(1), at_coarse), _packed_rows(per_sample(2), np.arange(len(seats.t[2]))),
            ], names=["word", "n", "contexts", "p", "coarse", "p_coarse", "p_root"])

    words = stage(cells.mapInArrow(probabilities, MODEL), "hpy_model")
    return Model(words, tokens or 0, types, [g.back_off(0) for g in kept], [g.back_off(1) for g in kept],
                 [float(g.back_off(2)[0] * uniform) for g in kept])


def _packed_rows(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """As ``_packed``, for rows of several numbers."""
    return _packed(np.ascontiguousarray(values).ravel(), np.asarray(starts) * values.shape[1])


# ---- scores -------------------------------------------------------------------------------

def _events(docs: DataFrame) -> DataFrame:
    """Per run and word: its tokens as document << 16 | context; the end token's row has the ids."""
    schema = "word binary, run long, tokens binary, ids binary, no_id binary"

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for number, (words, word, context, doc, ids) in enumerate(_runs(batches)):
            order = np.argsort(word, kind="stable")
            word, token = word[order], (doc[order] << np.uint32(16) | context[order]).astype("<u4")
            starts = _groups(word)
            ends, names = np.append(starts, len(word)), word[starts].tolist()
            for a in range(0, len(starts), ROWS):
                b = min(a + ROWS, len(starts))
                first = a == 0  # the end token has the number 0
                rest = [None] * (b - a - 1)
                row_ids = np.array([i or 0 for i in ids], "<i8").tobytes() if first else None
                no_id = np.array([i is None for i in ids], "u1").tobytes() if first else None
                yield pa.RecordBatch.from_arrays([
                    pa.array([words[i] for i in names[a:b]], pa.binary()), pa.array(np.full(b - a, task + number)),
                    _packed(token[ends[a]:ends[b]], starts[a:b] - ends[a]),
                    pa.array([row_ids, *rest], pa.binary()), pa.array([no_id, *rest], pa.binary()),
                ], names=["word", "run", "tokens", "ids", "no_id"])

    return whole_texts(docs).mapInArrow(listed, schema)


class _Sums:
    """Sums of the documents of some runs."""

    def __init__(self) -> None:
        self.runs: dict[int, list] = {}

    def of(self, run: int) -> list:
        if run not in self.runs:
            self.runs[run] = [np.zeros((4, 0)), None, None]  # (tokens, known, base, score) by document
        return self.runs[run]

    def add(self, run: int, docs: np.ndarray, values: np.ndarray) -> None:
        mine = self.of(run)
        size = int(docs.max()) + 1 if len(docs) else 0
        if size > mine[0].shape[1]:
            mine[0] = np.concatenate([mine[0], np.zeros((4, size - mine[0].shape[1]))], axis=1)
        for k in range(4):
            mine[0][k, :size] += np.bincount(docs, values[k], size) if values[k] is not None else np.bincount(docs, minlength=size)


PARTS = "run long, docs binary, tokens binary, known binary, base binary, score binary, ids binary, no_id binary"


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, base_score and score (log10), perplexity.

    ``docs`` should be a stored table: a task that runs again must see the same rows."""
    # A word has one row in the model, so a hash table of a task's words is small; the far more
    # numerous rows of tokens need no sort.
    joined = _events(docs).join(model.words.hint("shuffle_hash"), "word", "left").select(
        "run", "tokens", "ids", "no_id", "n", "contexts", "p", "coarse", "p_coarse", "p_root"
    )
    back_off, back_off_coarse = np.array(model.back_off), np.array(model.back_off_coarse)
    unknown, samples = np.array(model.unknown), len(model.unknown)
    whole = model.tokens + 0.5 * (model.types + 1)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                _score(batch.slice(start, 2048), sums)
                if len(sums.runs) > OPEN:
                    yield _parts(sums)
                    sums = _Sums()
        if sums.runs:
            yield _parts(sums)

    def _score(batch: pa.RecordBatch, sums: _Sums) -> None:
        cols = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        token, sizes = _flat(cols["tokens"], "<u4")
        row = np.repeat(np.arange(batch.num_rows), sizes)
        context, doc = (token & np.uint32(0xFFFF)).astype(np.int64), (token >> np.uint32(16)).astype(np.int64)
        n = cols["n"].fill_null(0).to_numpy()
        known = n[row] > 0
        # The word's own probability where no seat is found, then the coarse context's, then the context's.
        p_root = np.tile(unknown, (batch.num_rows, 1))
        at_root, held = _flat(cols["p_root"], "<f4")
        p_root[held > 0] = at_root.reshape(-1, samples)
        up = back_off_coarse[:, context // FINE].T * p_root[row]
        coarse, n_coarse = _flat(cols["coarse"], "u1")
        found, place = _lookup(row, context // FINE, n_coarse, coarse, COARSE)
        up[found] = _flat(cols["p_coarse"], "<f4")[0].reshape(-1, samples)[place[found]]
        p = (back_off[:, context].T * up).mean(axis=1)
        cells, n_cells = _flat(cols["contexts"], "<u2")
        found, place = _lookup(row, context, n_cells, cells, COARSE * FINE)
        p[found] = _flat(cols["p"], "<f4")[0][place[found]]
        base = np.log10((n + 0.5) / whole)[row]
        score = np.log10(p)
        runs = cols["run"].to_numpy()
        of_token = runs[row]
        order = np.argsort(of_token, kind="stable")
        starts = _groups(of_token[order])
        for a, b in zip(starts, np.append(starts[1:], len(order))):
            some = order[a:b]
            sums.add(int(of_token[some[0]]), doc[some], [None, known[some], base[some], score[some]])
        for i in np.flatnonzero(cols["ids"].is_valid().to_numpy(zero_copy_only=False)):
            mine = sums.of(int(runs[i]))
            mine[1], mine[2] = cols["ids"][i].as_py(), cols["no_id"][i].as_py()

    def _parts(sums: _Sums) -> pa.RecordBatch:
        rows = []
        for run, (values, ids, no_id) in sums.runs.items():
            some = np.flatnonzero(values[0])
            rows.append({
                "run": run, "docs": some.astype("<u2").tobytes(), "tokens": values[0, some].astype("<u4").tobytes(), "known": values[1, some].astype("<u4").tobytes(),
                "base": values[2, some].tobytes(), "score": values[3, some].tobytes(), "ids": ids, "no_id": no_id,
            })
        return pa.RecordBatch.from_pylist(rows, schema=parts_schema)

    out = "doc_id long, n_tokens long, n_known long, base_score double, score double"

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, sums = None, _Sums()
        for batch in batches:
            for r in batch.to_pylist():
                if r["run"] != run and run is not None:
                    yield _documents(sums)
                    sums = _Sums()
                run = r["run"]
                docs = np.frombuffer(r["docs"], "<u2").astype(np.int64)
                values = [np.frombuffer(r[c], k).astype(np.float64) for c, k in (("tokens", "<u4"), ("known", "<u4"), ("base", "<f8"), ("score", "<f8"))]
                sums.add(run, docs, values)
                if r["ids"] is not None:
                    sums.of(run)[1:] = r["ids"], r["no_id"]
        if run is not None:
            yield _documents(sums)

    def _documents(sums: _Sums) -> pa.RecordBatch:
        values, ids, no_id = next(iter(sums.runs.values()))
        mask = np.frombuffer(no_id, "u1").astype(bool)
        return pa.RecordBatch.from_arrays([
            pa.array(np.frombuffer(ids, "<i8"), mask=mask), pa.array(values[0].astype(np.int64)), pa.array(values[1].astype(np.int64)),
            pa.array(values[2]), pa.array(values[3]),
        ], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    parts_schema = arrow_schema(docs, PARTS)
    parts = joined.mapInArrow(scored, PARTS)
    rows = parts.repartition("run").sortWithinPartitions("run").mapInArrow(gathered, out)
    return rows.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def _lookup(row: np.ndarray, key: np.ndarray, sizes: np.ndarray, cells: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether (row, key) is among the sorted cells of its row, and where in all cells."""
    have = np.repeat(np.arange(len(sizes)), sizes) * wide + cells
    asked = row * wide + key
    place = np.searchsorted(have, asked)
    place = np.minimum(place, max(0, len(have) - 1))
    return (have[place] == asked if len(have) else np.zeros(len(asked), bool)), place


def scored_documents(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, score all: held_out, train_tokens and the scores.

    Seated by the words before themselves (``word_seats``), with the classes above them."""
    from .word_seats import score_all

    scores, tokens = score_all(docs, BURN, SAMPLES)
    return scores.select(
        "doc_id", held_out(F.col("doc_id"), MODULUS).alias("held_out"), "n_tokens", "n_known",
        F.lit(int(tokens)).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )

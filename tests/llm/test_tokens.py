"""Token files, counts and packing against the tokenizer libraries."""

from __future__ import annotations

import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from jobsight.session import scratch_path
from jobsight.llm import packing, pfor, tokens, viterbi
from jobsight.llm.text import pieces

import public_tokenizers

WORD_FILE, PIECE_FILE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def ids_of(doc_rows):
    """Ids of every fixture row by the library itself."""
    tokenizer = Tokenizer.from_file(WORD_FILE)
    return [(i, tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in doc_rows]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    """Also for a tokenizer that keeps white space, where texts don't fall into words."""
    rng = random.Random(3)
    parts = ["The", "don't", "I'LL", "x1y22", "Ünï", "éa", "é", "Σας", "日本", "ﬁ", "½", "!!..", "<|endoftext|>", "<|ENDOFTEXT|>", "\x1c", " ", " ", "😀", "'S", "ÿ×÷"]
    path = public_tokenizers.path(name)
    library, own = Tokenizer.from_file(path), tokens.TextEncoder(path)
    for _ in range(300):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", "\n", " \t\r", "\v\f"]) for _ in range(rng.randrange(12)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text.encode()) == struct.pack(f"<{len(ids)}I", *ids), text


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 5)
    own = tokens.TextEncoder(WORD_FILE)
    text = " ".join(f"w{i % 9}" for i in range(60)).encode()
    assert own.encode(text) == tokens.TextEncoder(WORD_FILE).encode(text) and len(own._words) <= 5


def test_pieces_cut_no_word():
    text = b"  aa bbb\tcccc " * 50 + b"x" * 500
    assert b"".join(pieces(text, 7)) == text
    assert [w for p in pieces(text, 7) for w in p.split()] == text.split()


def test_token_files(docs, ids_of):
    got = [tuple(r) for r in pfor.token_files(docs, WORD_FILE).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert Counter((i, n, c) for i, _, n, c in got) == Counter((i, len(x) + 1, crc([*x, 1])) for i, x in ids_of)
    at, last = 0, -1
    for i, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at and (i is None or i >= last)
        at, last = at + n, -1 if i is None else i


def test_rows_of_one_id_have_one_order(spark):
    """Null and repeated ids with different texts: the same starts however the rows are dealt, over several files."""
    rows = [(None if i % 3 else 7, f"text {i % 90} " + "word " * (i % 11)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    runs = []
    for dealt in (docs.repartition(1), docs.repartition(7), docs.orderBy(F.desc("text"))):
        got = pfor.token_files(dealt, WORD_FILE).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
        runs.append(sorted((tuple(r) for r in got), key=lambda r: r[1]))
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 300
    folder = scratch_path(spark, "ties")
    files = pfor.write_token_files(docs, WORD_FILE, f"file://{folder}").collect()
    assert max(f["docs"] for f in files) < 150


def test_blocks_of_a_file(docs, tmp_path):
    """Any block can be read by the index alone."""
    folder = f"file://{tmp_path}/ids"
    for r in pfor.write_token_files(docs, WORD_FILE, folder).collect():
        whole = np.concatenate([x for _, runs in pfor.read_file(folder, r["name"]) for x in runs])
        assert len(whole) == r["ids"]
        for b in {0, r["ids"] // pfor.BLOCK // 2, (r["ids"] - 1) // pfor.BLOCK}:
            assert (pfor.read_ids(folder, r["name"], b) == whole[b * pfor.BLOCK:(b + 1) * pfor.BLOCK]).all()


@pytest.mark.parametrize("high,odd", [(1, 0), (2, 3), (50_000, 40), (2**32, 0), (1000, 60)])
@pytest.mark.parametrize("n", [1, 1023, 1024, 1025, 5000])
def test_blocks_round_trip(high, odd, n):
    rng = np.random.default_rng(n + odd)
    ids = rng.integers(0, high, n, dtype=np.uint32 if high < 2**32 else np.uint64).astype(np.uint32)
    ids[rng.integers(0, n, odd)] = 2**32 - 1
    coded = pfor.encode_blocks(ids)
    assert (np.concatenate([pfor.decode_block(c) for c in coded]) == ids).all()
    assert len(coded) == -(-n // pfor.BLOCK)


def test_outliers_are_exceptions():
    """A few large ids don't widen a block."""
    ids = np.arange(1024, dtype=np.uint32) % 16
    ids[::200] = 1_000_000
    assert len(pfor.encode_blocks(ids)[0]) < 1024 * 4 // 8 + 60


def test_packing(docs, ids_of):
    rows = packing.pack(docs, WORD_FILE).collect()
    want = Counter()
    for i, x in ids_of:
        x = [*x, 0]
        for k in range(0, len(x), 2048):
            want[i, k // 2048, k, len(x[k:k + 2048]), crc(x[k:k + 2048])] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(len(x) + 1 for _, x in ids_of)
    assert len(sequences) <= -(-total // 2048) + 1


def test_tree_rounds(spark, docs, monkeypatch):
    """With few items to a task, several rounds merge the rests of many tasks."""
    monkeypatch.setattr(packing, "ITEMS", 7)
    rows = packing.pack(docs.repartition(16), WORD_FILE)
    fill = [r["n"] for r in rows.groupBy("sequence_id").agg({"length": "sum"}).toDF("id", "n").collect()]
    assert max(fill) <= 2048 and sum(1 for f in fill if f < 1024) <= 3


def test_rests_of_different_tasks_meet(spark, monkeypatch):
    """A few short texts among many that leave them no room: a round that saves little is not the last."""
    monkeypatch.setattr(packing, "ITEMS", 7)
    rows = [(i, " ".join(["stone"] * (300 if i % 50 == 0 else 1900))) for i in range(300)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(64), WORD_FILE)
    fill = [r["n"] for r in packed.groupBy("sequence_id").agg({"length": "sum"}).toDF("id", "n").collect()]
    total = sum(fill)
    assert max(fill) <= 2048 and sum(1 for f in fill if f <= 1024) <= 1
    assert total == sum(len(t.split()) + 1 for _, t in rows) and len(fill) == 295


def test_best_fit_is_best_fit():
    """Every item goes to the fullest bin with room, as a plain search says."""
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 101, 400)
    plain = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        fits = [b for b in plain if sum(sizes[b]) + sizes[i] <= 100]
        if fits:
            max(fits, key=lambda b: sum(sizes[b])).append(i)
        else:
            plain.append([i])
    assert len(packing.best_fit(sizes, 100)) == len(plain)


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_counts_equal_library(docs, doc_rows, byte_fallback):
    """The vocabulary as a unigram model of the library, on whole texts."""
    vocabulary = viterbi.read_vocabulary(PIECE_FILE)
    library = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=byte_fallback))
    library.normalizer = normalizers.Sequence([normalizers.Replace(Regex("[ \t-\r]+"), " "), normalizers.Replace(Regex("^ | $"), "")])
    library.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(" ", "removed"), pre_tokenizers.Metaspace("▁", "always", split=False)])
    library.decoder = decoders.Metaspace()
    got = viterbi.token_counts(docs, PIECE_FILE, byte_fallback).select("doc_id", "n_tokens").collect()
    assert Counter(map(tuple, got)) == Counter((i, len(library.encode(t or "").ids)) for i, t in doc_rows)


def test_ties_as_in_the_library():
    """A small vocabulary of equal scores: many paths tie."""
    rng = random.Random(2)
    for trial in range(40):
        names = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(8)} | {"▁"}
        vocabulary = [("<unk>", 0.0), *((n, -float(rng.randrange(1, 3))) for n in sorted(names))]
        model, own = models.Unigram(vocabulary, unk_id=0, byte_fallback=False), viterbi.Counter(vocabulary, False)
        for _ in range(30):
            word = "▁" + "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 10)))
            assert own.word(word)[0] == len(model.tokenize(word)), (vocabulary, word)


def test_empty(empty):
    assert pfor.token_files(empty, WORD_FILE).count() == 0
    assert packing.pack(empty, WORD_FILE).count() == 0
    assert viterbi.token_counts(empty, PIECE_FILE).count() == 0

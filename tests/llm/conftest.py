"""Small frames that hold the awkward cases."""

from __future__ import annotations

import random

import pytest

WORDS = "the of and to in a is that it on for with as be are was stupid idiot river stone lamp garden window table paper".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


def documents() -> list[tuple]:
    """Nulls in every column, empty and blank texts, copies, repeated rows, near copies, ties and one long text."""
    rng = random.Random(1)
    texts = [prose(rng, rng.randrange(1, 120)) for _ in range(60)]
    rows = [(i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i % 3], "de", "src0", None) for i in range(40)]  # a hot text in a hot source
    rows += [(200, None, None, None, None), (201, "", "", "", 0), (202, " \n\t ", "en", "src1", 4), (203, None, "en", None, 0)]
    rows += [(300, texts[5], "en", "src1", 1)] * 3  # repeated rows
    rows += [(None, texts[6], "en", "src2", 1), (None, None, None, None, None), (None, texts[6], "en", "src2", 1)]
    near = texts[10].split()
    rows += [(400 + i, " ".join([*near[:-1], f"other{i}"]), "en", "ünï", 9) for i in range(5)]
    rows += [(500, prose(rng, 30_000), "en", "src3", 1), (501, "x" * 50_000, "en", "src3", 1), (502, "one two three", "en", "src3", 1)]
    rows += [(600, "Ünïcode Ärger ﬁ ½ 日本語 é don't I'M <|endoftext|>   \x1c a b 😀", "en", "src3", 1)]
    return rows


def with_clashes(df):
    """Columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    names = "size n place target copies fp node root _row _key _text _salt _order _n run tokens score y x part start fill pieces".split()
    return df.select("*", *[F.lit(f"kept {c}").alias(c) for c in names])


@pytest.fixture(scope="session")
def docs(spark):
    return with_clashes(spark.createDataFrame(documents(), SCHEMA).repartition(5)).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def doc_rows():
    return [r[:2] for r in documents()]

"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import grid_codes, term_pipeline, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query, with the DuckDB SQL that gives the same rows if there is any."""

    def wrap(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            reach(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return wrap


def reach(spark: SparkSession) -> None:
    """Let Python workers find this package where it is not installed but lies in a shared folder."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(":")
    if root not in paths:
        env["PYTHONPATH"] = ":".join(p for p in [*paths, root] if p)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_permutation_index")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .permutation_index import nearest, usable

    vectors = usable(_table(spark, sf_dir, "embeddings"))
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .viterbi import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op3_mix_sources")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"))


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores, train

    docs = _table(spark, sf_dir, "documents")
    return quality_scores(docs, train(docs, _table(spark, sf_dir, "labels")))


@query("op5_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import duplicate_groups

    return duplicate_groups(_table(spark, sf_dir, "documents"))


@query("op6_token_files")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pfor import token_files
    from .tokens import default_path

    return token_files(_table(spark, sf_dir, "documents"), default_path())


@query("op7_pitman_yor")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hpylm import scored_documents

    return scored_documents(_table(spark, sf_dir, "documents"))


@query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    return simhash_groups(_table(spark, sf_dir, "documents"))


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack
    from .tokens import default_path

    return pack(_table(spark, sf_dir, "documents"), default_path())


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores, train

    docs = _table(spark, sf_dir, "documents")
    return toxicity_scores(docs, train(docs, _table(spark, sf_dir, "labels")))


@query("op11_salvaged_archives", warc.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


@query("op12_term_pipeline", term_pipeline.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_pipeline.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query("op13_grid_codes", grid_codes.sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_codes.vector_codes(_table(spark, sf_dir, "embeddings"))

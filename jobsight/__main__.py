"""Command line.

    spark-submit ... -m jobsight prepare SOURCE OUTPUT MANIFEST
    python -m jobsight clean SOURCE OUTPUT LOG
    python -m jobsight train SOURCE TARGET REGISTRY [--task regression]
    python -m jobsight score SOURCE OUTPUT REGISTRY [--experiment ID]
    python -m jobsight drift SOURCE OUTPUT REGISTRY [--experiment ID] [--threshold 0.35]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from jobsight import fixed_values as fv
from jobsight.operators.registry import Registry
from jobsight.plans import workflows
from jobsight.session import get_session, run_folder
from jobsight.sources.files import load_dataset, write_dataset


def _arguments(given: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="jobsight")
    steps = parser.add_subparsers(dest="step", required=True)
    second = {
        "prepare": ("output", "manifest"), "clean": ("output", "log"), "train": ("target", "registry"),
        "score": ("output", "registry"), "drift": ("output", "registry"),
    }
    for step, names in second.items():
        one = steps.add_parser(step)
        one.add_argument("source", help="delimited text, parquet, ORC or JSON dataset")
        for name in names:
            one.add_argument(name, help="a column, a folder, or a file whose extension decides the format")
        one.add_argument("--encoding", default="UTF-8", help="character encoding of delimited text")
        one.add_argument("--multi-line", action="store_true", default=None, help="read delimited files whole, one task each")
        if step == "train":
            one.add_argument("--task", choices=["classification", "regression"], help="default: by the target")
        if step in ("score", "drift"):
            one.add_argument("--experiment", help="default: the active one")
        if step == "drift":
            one.add_argument("--threshold", type=float, default=fv.DRIFT_ALERT)
    return parser.parse_args(given)


def _step(args: argparse.Namespace, spark: SparkSession) -> None:
    if args.step in ("prepare", "clean"):
        source = load_dataset(spark, args.source, args.encoding, args.multi_line)
        if args.step == "prepare":
            write_dataset(workflows.write_safe_dataset(source, args.output), args.manifest)
        else:
            write_dataset(workflows.write_cleaned(source, args.output), args.log)
        return
    registry = Registry(spark, args.registry)
    if args.step == "train":
        rows = workflows.typed_dataset(spark, args.source, args.encoding, args.multi_line)
        done = workflows.train_model(rows, args.target, registry, args.task, dataset_path=args.source)
        print(done["experiment"]["id"], done["result"].best_model_name, done["experiment"]["metric_value"])
        return
    experiment = args.experiment or registry.active()
    if args.step == "score":
        workflows.batch_predict(registry, experiment, args.source, args.output, args.encoding, args.multi_line)
        return
    current = workflows.typed_dataset(spark, args.source, args.encoding, args.multi_line)
    report = workflows.drift_report(registry, experiment, current, args.threshold)
    print(report["summary"].first().asDict())
    write_dataset(report["features"], args.output)


def main(given: list[str] | None = None) -> None:
    """Run a step; all results are files, so what it stages goes with it."""
    args, spark = _arguments(given), get_session()
    with run_folder(spark):
        _step(args, spark)


if __name__ == "__main__":
    main()

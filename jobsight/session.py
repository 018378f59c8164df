"""Session settings and the shared scratch location."""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: a fixed zone for dates, ANSI errors instead of
# silent nulls, and run-time re-planning (partition coalescing, skewed joins).
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


#: Setting of one session that takes the place of ``spark.checkpoint.dir``.
SHARED = "spark.jobsight.shared"


def get_session(app_name: str = "jobsight", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or get) a session with the package defaults; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A session may name another such folder by ``SHARED``. Only a local session may fall back to
    a folder of this machine: on a cluster a missing setting is an error, because an
    executor's disk dies with it.
    """
    named = spark.conf.get(SHARED, None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder shared by all executors.")
    own = tempfile.mkdtemp(prefix="jobsight-")
    spark.conf.set(SHARED, own)  # the other setting cannot be changed in a running session
    return own


#: Setting of a session that names the folder of its present run, and the record of who owns it.
RUN, OWNER = "spark.jobsight.run", "_owner.json"
#: Seconds a run may go without writing a staged table before a later run takes it for dead.
LEASE = 7 * 24 * 3600


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder of the run, if there is one, else below the shared folder
    (never reused, so nothing is overwritten)."""
    return f"{spark.conf.get(RUN, None) or f'{shared_dir(spark)}/jobsight'}/{name}-{uuid.uuid4().hex}"


def _store(path: str) -> tuple[pafs.FileSystem | None, str]:
    """The file system of a path and the path in it; None where Arrow has no such file system."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    try:
        return pafs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return None, path


def _sign(path: str, lease: float) -> None:
    """Say in the folder of a run until when it is surely in use."""
    store, folder = _store(path)
    if store is None:
        return
    store.create_dir(folder)
    part = f"{folder}/{OWNER}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(json.dumps({"lease": lease, "until": time.time() + lease}).encode())
    store.move(part, f"{folder}/{OWNER}")


def _owner(path: str) -> dict | None:
    """The record of a run; None if there is none."""
    store, folder = _store(path)
    try:
        with store.open_input_stream(f"{folder}/{OWNER}") as record:
            return json.loads(record.read())
    except FileNotFoundError:
        return None


def _remove_abandoned(parent: str) -> None:
    """Remove the runs below a folder whose owner has let the lease pass."""
    store, folder = _store(parent)
    if store is None:
        return
    for found in store.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
        if found.type == pafs.FileType.Directory and found.base_name.startswith("run-"):
            record = _owner(f"{parent}/{found.base_name}")
            if record is not None and record["until"] < time.time():
                store.delete_dir(found.path)


@contextmanager
def run_folder(spark: SparkSession, lease: float = LEASE) -> Iterator[str]:
    """A run (S8): tables staged inside go to a folder of its own, removed at the end, also after an
    error. Write what shall last before the run ends: frames that read staged tables end with it.

    A run whose driver died is removed by a later one, once its lease has passed; every staged table
    renews the lease, and runs in use, or without a record, are let be. A run inside another is a
    part of it. Runs side by side need a session each, as the folder is a setting of the session. In
    a store that Arrow cannot open nothing is removed.
    """
    outer = spark.conf.get(RUN, None)
    if outer is None:
        _remove_abandoned(f"{shared_dir(spark)}/jobsight")
    path = scratch_path(spark, "run")
    _sign(path, lease)
    spark.conf.set(RUN, path)
    try:
        yield path
    finally:
        if outer is None:
            spark.conf.unset(RUN)
        else:
            spark.conf.set(RUN, outer)
        store, folder = _store(path)
        if store is not None:
            store.delete_dir(folder)


def _renew(spark: SparkSession) -> None:
    """Renew the lease of the present run and of those it is a part of."""
    path = spark.conf.get(RUN, None)
    while path and path.rsplit("/", 1)[-1].startswith("run-"):
        if _store(path)[0] is not None and (record := _owner(path)) is not None:
            _sign(path, record["lease"])
        path = path.rsplit("/", 1)[0]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, asked through a reader, so in any store that Spark reads."""
    try:
        return bool(spark.read.format("binaryFile").load(path).columns)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several later passes need the same rows: the written table survives
    lost executors, is pruned and filtered at the scan, and gives the optimizer
    real sizes for its join choices.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    _renew(df.sparkSession)
    return df.sparkSession.read.parquet(path)

"""The tables of a run in one folder, with a manifest that tells whether they are whole and unchanged.

The manifest has a row for each table: columns, rows, a digest of the content that
doesn't depend on the order of rows or files, and the size and SHA-256 of each file.
``run`` beside it says in JSON what the run was: its settings, where its code and
libraries came from, and what it found.
"""

from __future__ import annotations

import hashlib
import json
import platform
import subprocess
import sys
from collections.abc import Callable, Iterable
from importlib.metadata import PackageNotFoundError, version
from pathlib import Path
from typing import TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from larder.sources.panel import write_table

MANIFEST, RUN = "manifest", "run"
T = TypeVar("T")
_FILES = "array<struct<path: string, bytes: long, sha256: string>>"
_SCHEMA = f"name string, columns array<string>, n_rows long, digest string, files {_FILES}"
#: Files above this are told by size and by the table's digest alone, as a task reads a file whole to hash it.
HASHED_BYTES = 512 << 20
#: Libraries whose versions a run records.
LIBRARIES = ("pyspark", "pyarrow", "pandas", "numpy")


class ArtifactError(ValueError):
    """Tables are missing or differ from their manifest."""


def _digest(df: DataFrame) -> list:
    return [F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("digest")]


def summary(df: DataFrame) -> tuple[int, str]:
    """Number of rows, and the sum of the rows' hashes: the same in any order of rows."""
    found = df.agg(*_digest(df)).first()
    return found["n"], str(found["digest"] or 0)


def files_of(spark: SparkSession, path: str) -> dict[str, tuple[int, str | None]]:
    """Size and SHA-256 of each data file below ``path``, by its path there; hashed in tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small, large = files.filter(F.col("length") <= HASHED_BYTES), files.filter(F.col("length") > HASHED_BYTES)
    rows = small.select("path", "length", F.sha2("content", 256).alias("sha")).union(large.select("path", "length", F.lit(None).cast("string")))
    top = path.split(":", 1)[-1].rstrip("/").lstrip("/") + "/"
    return {r.path.split(top, 1)[-1]: (r.length, r.sha) for r in rows.collect()}  # a row for each file of a table


def write_artifacts(spark: SparkSession, tables: dict[str, DataFrame], out_dir: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Write every table and the manifest; nothing is written if a required table is missing.

    Rows and digest are observed while a table is written, so no table is read again for them.
    """
    if missing := sorted(set(required) - set(tables)):
        raise ArtifactError(f"missing required artifacts: {missing}")
    rows = []
    for name, df in tables.items():
        seen = Observation()
        write_table(df.observe(seen, *_digest(df)), f"{out_dir}/{name}")
        files = [Row(path=p, bytes=n, sha256=sha) for p, (n, sha) in sorted(files_of(spark, f"{out_dir}/{name}").items())]
        rows.append(Row(name, df.columns, seen.get["n"], str(seen.get["digest"] or 0), files))
    manifest = spark.createDataFrame(rows, _SCHEMA)
    write_table(manifest.coalesce(1), f"{out_dir}/{MANIFEST}")
    return manifest


def write_run(spark: SparkSession, said: dict, out_dir: str) -> None:
    """What a run says of itself, as JSON beside its manifest."""
    spark.createDataFrame([(json.dumps(said, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out_dir}/{RUN}")


def read_run(spark: SparkSession, out_dir: str) -> dict:
    """What the run said of itself; an empty object if it said nothing."""
    try:
        return json.loads(spark.read.text(f"{out_dir}/{RUN}", wholetext=True).first()[0])
    except PySparkException:
        return {}


def provenance() -> dict:
    """The commit of this package, whether it was changed since, a hash of each source file, and versions."""
    home = Path(__file__).resolve().parents[1]

    def git(*words: str) -> str | None:
        try:
            return subprocess.run(["git", "-C", str(home), *words], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return None

    def installed(name: str) -> str | None:
        try:
            return version(name)
        except PackageNotFoundError:
            return None

    changes = git("status", "--porcelain", "--", str(home))
    sources = {str(p.relative_to(home.parent)): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(home.rglob("*.py"))}
    return {"git_commit": git("rev-parse", "HEAD"), "working_tree_dirty": None if changes is None else bool(changes), "source_sha256": sources, "runtime": {"python": sys.version.split()[0], "platform": platform.platform(), **{k: installed(k) for k in LIBRARIES}}}


def _manifest(spark: SparkSession, out_dir: str) -> list[Row] | None:
    try:
        return spark.read.parquet(f"{out_dir}/{MANIFEST}").collect()  # one row a table
    except PySparkException:
        return None


def read_artifacts(spark: SparkSession, out_dir: str) -> dict[str, DataFrame]:
    """All tables of the manifest by name, also as temporary views for SQL."""
    found = {}
    for row in spark.read.parquet(f"{out_dir}/{MANIFEST}").collect():
        found[row.name] = spark.read.parquet(f"{out_dir}/{row.name}")
        found[row.name].createOrReplaceTempView(row.name)
    return found


def _file_faults(known: Iterable[Row], there: dict[str, tuple[int, str | None]]) -> list[str]:
    """What happened to single files: truncated, changed, renamed, missing or new."""
    known = {f.path: (f.bytes, f.sha256) for f in known}
    gone, new = sorted(set(known) - set(there)), sorted(set(there) - set(known))
    out = []
    for path in sorted(set(known) & set(there)):
        (n, sha), (now, now_sha) = known[path], there[path]
        if now < n:
            out.append(f"{path} is truncated, {now} of {n} bytes")
        elif (n, sha) != (now, now_sha):
            out.append(f"{path} has other bytes")
    for path in gone:
        other = next((x for x in new if there[x] == known[path]), None)
        out.append(f"{path} is missing" if other is None else f"{path} was renamed to {other}")
        new = [x for x in new if x != other]
    return out + [f"{path} is new" for path in new]


def _tried(make: Callable[[], T]) -> T | None:
    """What ``make`` gives, or None where Spark can't read it."""
    try:
        return make()
    except (PySparkException, Py4JJavaError):
        return None


def _table_faults(spark: SparkSession, out_dir: str, row: Row) -> list[str]:
    path = f"{out_dir}/{row.name}"
    there = _tried(lambda: files_of(spark, path))
    if not there:
        return ["missing or unreadable"]
    faults = _file_faults(row.files, there)
    if not faults and all(sha for _, sha in there.values()):
        return []
    df = _tried(lambda: spark.read.parquet(path))
    if df is not None and df.columns != row.columns:
        return ["columns changed"]
    now = None if df is None else _tried(lambda: summary(df))
    if now is not None and now != (row.n_rows, row.digest):
        return ["content changed"]
    return faults if now is not None else faults or ["unreadable"]


def artifact_problems(spark: SparkSession, out_dir: str, required: tuple[str, ...] = (), not_empty: tuple[str, ...] = ()) -> list[str]:
    """What is missing, changed, empty or not among the ``required`` tables (if any are named); an empty list for a folder in order.

    A table whose files are those of the manifest isn't read again.
    """
    rows = _manifest(spark, out_dir)
    if rows is None:
        return ["no manifest"]
    problems = [f"{name}: not in the manifest" for name in sorted(set(required) - {r.name for r in rows})]
    problems += [f"{name}: not expected" for name in sorted({r.name for r in rows} - set(required)) if required]
    for row in rows:
        problems += [f"{row.name}: {fault}" for fault in _table_faults(spark, out_dir, row)]
        problems += [f"{row.name}: empty"] * (row.name in not_empty and not row.n_rows)
    return problems


def open_artifacts(spark: SparkSession, out_dir: str, required: tuple[str, ...] = (), not_empty: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """``read_artifacts`` of a folder in order; an error that lists every problem otherwise."""
    if problems := artifact_problems(spark, out_dir, required, not_empty):
        raise ArtifactError("; ".join(problems))
    return read_artifacts(spark, out_dir)

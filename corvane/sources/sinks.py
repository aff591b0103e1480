"""What is written: training chats, reports, results.

What goes out is seen once. Counts, digests and measures are observed in the pass that writes the
rows (``DataFrame.observe``), so that a report says what is in its files, and an export's files
become visible together, by one rename, with a manifest of what they hold.
"""

from __future__ import annotations

import json
import os
import posixpath
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corvane.operators.metrics import case_measures, summary_columns
from corvane.session import files_of, put_files

# Which splits are exported, and under which names.
EXPORTED = {"train": "train", "validation": "valid"}
MANIFEST = "manifest.json"
STAGING = ".staging-"


def resolved(path: str) -> str:
    """A path as a comparison needs it: absolute, without ``.``, ``..`` and doubled slashes; on this machine without links, too.

    Schemes and hosts are compared without case; ``file:/x``, ``file:///x`` and ``/x`` are one.
    """
    parts = urlsplit(path)
    if len(parts.scheme) > 1 and parts.scheme.lower() != "file":
        return f"{parts.scheme.lower()}://{parts.netloc.lower()}{posixpath.normpath('/' + parts.path.lstrip('/'))}"
    return os.path.realpath(unquote(parts.path) if parts.scheme.lower() == "file" else path)


def guard_paths(data_dir: str, export_dir: str | None = None, report: str | None = None) -> None:
    """An export must not go where the data are, nor a report over a split's file, however either path is spelled."""
    if export_dir and resolved(export_dir) == resolved(data_dir):
        raise ValueError("the export folder is the data folder")
    if report and resolved(report) in {resolved(f"{data_dir.rstrip('/')}/{s}.jsonl") for s in ("train", "validation", "test")}:
        raise ValueError("the report would replace a split")


def contents(value: Column) -> list[Column]:
    """Number, bytes and digest of lines, whatever their order: two sums over their hashes, which equal lines don't cancel."""
    one, other = F.xxhash64(value), F.xxhash64(F.lit(1), value)
    whole = lambda h: F.sum(h.cast("decimal(20,0)")).cast("string")
    digest = F.sha2(F.concat_ws(":", F.count("*").cast("string"), whole(one), whole(other)), 256)
    return [F.count("*").alias("lines"), F.coalesce(F.sum(F.octet_length(value)), F.lit(0)).alias("bytes"), digest.alias("digest")]


def written_split(rows: DataFrame, path: str) -> dict:
    """Write rows(value) as lines and tell their contents."""
    seen = Observation(f"export-{uuid.uuid4().hex}")
    rows.observe(seen, *contents(F.col("value"))).write.mode("errorifexists").text(path)
    return dict(seen.get)


def export_chats(rows: DataFrame, folder: str, overwrite: bool = False, write: Callable[[DataFrame, str], dict] = written_split) -> dict:
    """rows(split, messages) as JSON lines, a folder for each exported split and a manifest of their contents; other splits are never written.

    All is written beside ``folder`` and gets its name by one rename, so whoever reads it sees
    both splits or none. A run that fails leaves ``folder`` as it was; what it had staged is
    deleted by the next. One writer at a time; the store must rename folders as a whole (HDFS and
    local disks do). An existing export is an error, or with ``overwrite`` makes way at the end.
    """
    spark, folder = rows.sparkSession, folder.rstrip("/")
    store, target = files_of(spark, folder)
    if store.exists(target) and not overwrite:
        raise FileExistsError(folder)
    for left in store.globStatus(files_of(spark, f"{folder}{STAGING}*")[1]) or []:
        store.delete(left.getPath(), True)
    staging = f"{folder}{STAGING}{uuid.uuid4().hex}"
    manifest = {}
    for split, name in EXPORTED.items():
        manifest[name] = write(rows.where(F.col("split") == split).select(F.to_json(F.struct("messages")).alias("value")), f"{staging}/{name}.jsonl")
    put_files(spark, staging, {MANIFEST: json.dumps(manifest, indent=1).encode()})
    staged, old = files_of(spark, staging)[1], files_of(spark, f"{staging}-old")[1]
    if store.exists(target) and not store.rename(target, old):
        raise OSError(f"{folder} can't be replaced")
    if not store.rename(staged, target):
        raise OSError(f"{staging} can't be renamed to {folder}")
    store.delete(old, True)
    return manifest


def export_problems(spark: SparkSession, folder: str) -> DataFrame:
    """name, recorded and found (lines:bytes:digest) of the splits of an export that aren't what its manifest says."""
    told = spark.read.option("multiLine", True).json(f"{folder}/{MANIFEST}").select(F.explode(F.from_json(F.to_json(F.struct("*")), "map<string,struct<lines:long,bytes:long,digest:string>>")).alias("name", "c"))
    recorded = told.select("name", F.concat_ws(":", "c.lines", "c.bytes", "c.digest").alias("recorded"))
    found = None
    for name in EXPORTED.values():
        one = spark.read.text(f"{folder}/{name}.jsonl").agg(*contents(F.col("value"))).select(F.lit(name).alias("name"), F.concat_ws(":", "lines", "bytes", "digest").alias("found"))
        found = one if found is None else found.unionByName(one)
    return recorded.join(found, "name", "full_outer").where(~F.col("recorded").eqNullSafe(F.col("found")))


def write_report(cases: DataFrame, folder: str, passed: bool | Callable[[dict], bool], histograms: dict[str, tuple[str, ...]] | None = None) -> dict:
    """Cases and their measures as JSON, also where checks fail; returns the measures, with whether they passed.

    One pass writes the cases and observes what ``metrics.summarise`` would compute, and of each
    column in ``histograms`` how many cases have each of the values, or another. ``passed`` may
    be a function of the measures.
    """
    counts = [F.count_if(F.col(column).eqNullSafe(F.lit(value))).alias(f"{column}={value}") for column, values in (histograms or {}).items() for value in values]
    others = [F.count_if(~F.coalesce(F.col(column).isin(*values), F.lit(False))).alias(f"{column}=*") for column, values in (histograms or {}).items()]
    seen = Observation(f"report-{uuid.uuid4().hex}")
    measured = case_measures(cases).observe(seen, *summary_columns(), *counts, *others)
    measured.select(*cases.columns).write.mode("overwrite").json(f"{folder.rstrip('/')}/cases")
    told = dict(seen.get)
    told["passed"] = bool(passed(told) if callable(passed) else passed)
    put_files(cases.sparkSession, f"{folder.rstrip('/')}/metrics", {"metrics.json": json.dumps(told, default=float).encode()})
    return told


def as_json(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One JSON text a row; with ``columns``, only those (a summary keeps private columns out)."""
    names = columns or df.columns
    return df.select(F.to_json(F.struct(*names)).alias("json"))

"""Knowledge documents from a JSON catalog, and other files that the checks read."""

from __future__ import annotations

import hashlib
import io
import os
import zipfile
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.html import ADVICE_ARTICLE, Gate, article_text
from corvane.functions.text import weak_key
from corvane.session import files_of
from corvane.sources.lines import numbered_lines, read_lines, tree_fingerprints

ENTRY = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "title", "category", "platform", "source_type", "file")]
    + [T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("sources", T.ArrayType(T.StructType([T.StructField("url", T.StringType())])))]
)
CATALOG = T.StructType([T.StructField("documents", T.ArrayType(ENTRY))])
#: Names of files that a catalog's entries can be read from.
READABLE = ("html", "txt")


def there(spark: SparkSession, path: str) -> bool:
    store, at = files_of(spark, path)
    return store.exists(at)


def catalog_entries(spark: SparkSession, folder: str) -> DataFrame:
    """ordinal (from 0) and columns of each entry of ``catalog.json``, one document, or of ``catalog.jsonl``, a file or folder of files with an entry a line."""
    if there(spark, f"{folder}/catalog.jsonl"):
        found = read_lines(spark, f"{folder}/catalog.jsonl").select((F.col("line") - 1).cast("int").alias("ordinal"), F.from_json("value", ENTRY).alias("d"))
    else:
        found = spark.read.option("multiLine", True).schema(CATALOG).json(f"{folder}/catalog.json").select(F.posexplode("documents").alias("ordinal", "d"))
    return found.select("ordinal", "d.*")


def catalog_files(spark: SparkSession, folder: str) -> DataFrame:
    """path below the folder and content of each file there, and of those packed as rows(path, content) of ``packed.parquet``: a path is in one of both."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{','.join(READABLE)}}}").load(folder)
    # entries name files below the folder: paths are compared from there on, whatever store, host and working directory come before
    store, at = files_of(spark, folder)
    root = store.makeQualified(at).toUri().getPath().rstrip("/") + "/"
    found = files.select(F.substring_index("path", root, -1).alias("path"), F.col("content").cast("string").alias("content"))
    if there(spark, f"{folder}/packed.parquet"):
        packed = spark.read.parquet(f"{folder}/packed.parquet").where(F.col("path").rlike(rf"\.({'|'.join(READABLE)})$"))
        found = found.unionByName(packed.select("path", F.col("content").cast("string").alias("content")))
    return found


def load_documents(spark: SparkSession, folder: str, gate: Gate = ADVICE_ARTICLE) -> DataFrame:
    """doc_id, ordinal, title, category, platform, source_type, tags, urls, text and problem of each catalog entry, in its order.

    original_html files give their article, authored_summary files of .txt their text. A file
    that is missing, empty or of another kind is a problem in its row, not an exception. A file
    of its own for each entry is listed by the driver and opened alone; catalogs of very many
    entries have them as lines of ``catalog.jsonl`` and their files as rows of ``packed.parquet``.
    """
    both = catalog_entries(spark, folder).join(catalog_files(spark, folder), F.col("file") == F.col("path"), "left")
    html = (F.col("source_type") == "original_html") & F.col("file").endswith(".html")
    plain = (F.col("source_type") == "authored_summary") & F.col("file").endswith(".txt")
    text = F.when(html, article_text(gate)(F.when(html, F.col("content")))).when(plain, F.regexp_replace("content", r"(?U)^\s+|\s+$", ""))
    told = both.withColumn("text", text)
    problem = F.when(F.col("path").isNull(), "missing file").when(~(html | plain), "unsupported source").when(F.coalesce(F.col("text"), F.lit("")) == "", "empty document")
    return told.select(
        F.col("id").alias("doc_id"), "ordinal", "title", "category", "platform", "source_type", "tags", F.transform("sources", lambda s: s["url"]).alias("urls"), "text", problem.alias("problem")
    ).orderBy("ordinal")


OBSERVATION = "struct<category:string,signals:array<struct<signal:string,evidence:string>>,issues:array<string>>"
EXAMPLE = (
    "id string, scenario_group string, language string, provenance string, source struct<dataset:string,record_number:int,original_label:string,raw_text_sha256:string,sanitization_version:int>, "
    f"review_status string, case_kind string, input_text string, expected {OBSERVATION}, rejected_output {OBSERVATION}, rejection_reason string, rationale string, reference_ids array<string>"
)
EXAMPLE_KEYS = tuple(part.split(" ")[0] for part in (
    "id", "scenario_group", "language", "provenance", "source", "review_status", "case_kind", "input_text", "expected", "rejected_output", "rejection_reason", "rationale", "reference_ids"))


def load_examples(spark: SparkSession, folder: str, splits: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """split, line, the example's columns and problem (null, "not json", "unknown key") of JSON lines files."""
    found = numbered_lines(spark, {split: f"{folder}/{split}.jsonl" for split in splits}).withColumnRenamed("name", "split")
    parsed = found.withColumn("e", F.from_json("value", EXAMPLE))
    keys = F.json_object_keys("value")
    problem = F.when(F.col("e").isNull() | keys.isNull(), "not json").when(F.size(F.array_except(keys, F.array(*map(F.lit, EXAMPLE_KEYS)))) > 0, "unknown key")
    return parsed.select("split", "line", "e.*", problem.alias("problem"))


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSON lines file, with the key by which they are compared with inputs."""
    schema = "id string, category string, `group` string, input string, levels array<string>, required_flags array<string>, actions_any array<string>, documents_any array<string>, private_markers array<string>"
    return spark.read.schema(schema).json(path).withColumn("input_key", weak_key(F.col("input")))


def load_replay(spark: SparkSession, path: str, run: str = "adapter", one_a_line: bool = False) -> DataFrame:
    """The cases of one run of an evaluation report, or of many, with one report in each line."""
    return spark.read.option("multiLine", not one_a_line).json(path).select(F.explode(F.col(f"runs.{run}.cases")).alias("case")).select("case.*")


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def split_fingerprints(spark: SparkSession, folder: str, splits: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """split and SHA-256 of the bytes of each split's file."""
    files = spark.read.format("binaryFile").load([f"{folder}/{split}.jsonl" for split in splits])
    return files.select(F.regexp_extract("path", r"([^/]+)\.jsonl$", 1).alias("split"), F.sha2("content", 256).alias("sha256"))


def split_trees(spark: SparkSession, folder: str, splits: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """split and the fingerprint of each split's lines as a tree of digests: for files that are too large for one row."""
    trees = tree_fingerprints(numbered_lines(spark, {split: f"{folder}/{split}.jsonl" for split in splits}))
    return trees.select(F.col("name").alias("split"), F.col("fingerprint").alias("sha256"))


def fingerprint_mismatches(observed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Splits whose (split, sha256) differ or that one side lacks."""
    a, b = observed.withColumnRenamed("sha256", "observed"), manifest.withColumnRenamed("sha256", "recorded")
    return a.join(b, "split", "full_outer").where(~F.col("observed").eqNullSafe(F.col("recorded")))


def read_archive(spark: SparkSession, path: str, member: str, sha256: str, rows: int | None = None, labels: dict[str, int] | None = None) -> DataFrame:
    """record_number (from 1), source_label and raw of a zipped file of tab-separated lines.

    The archive must have the checksum; with ``rows`` and ``labels`` its counts must be those.
    """
    kind = T.StructType([T.StructField("record_number", T.LongType()), T.StructField("source_label", T.StringType()), T.StructField("raw", T.StringType())])
    arrow = pa.schema([("record_number", pa.int64()), ("source_label", pa.string()), ("raw", pa.string())])

    def unpack(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                if hashlib.sha256(content).hexdigest() != sha256:
                    raise ValueError("the archive's checksum differs")
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    pairs = [line.split("\t", 1) for line in z.read(member).decode().splitlines()]
                yield pa.RecordBatch.from_pydict({"record_number": list(range(1, len(pairs) + 1)), "source_label": [p[0] for p in pairs], "raw": [p[1] for p in pairs]}, schema=arrow)

    archive = spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, kind)
    if rows is not None or labels is not None:
        found = {r["source_label"]: r["count"] for r in archive.groupBy("source_label").count().collect()}
        if (rows is not None and sum(found.values()) != rows) or (labels is not None and found != labels):
            raise ValueError(f"unexpected rows or labels: {found}")
    return archive


@dataclass(frozen=True)
class Settings:
    """Where a local model would be; the engine runs without one."""

    model: str | None
    adapter_dir: str
    device: str


def load_settings(env_file: str = ".env") -> Settings:
    """From the environment, then from a file of NAME=value lines."""
    values = {}
    if Path(env_file).is_file():
        for line in Path(env_file).read_text().splitlines():
            name, sign, value = line.strip().partition("=")
            if sign and not name.startswith("#"):
                values[name.strip()] = value.strip().strip("'\"")
    get = lambda name, default=None: os.environ.get(name) or values.get(name) or default
    return Settings(get("LOCAL_MODEL_PATH"), get("LOCAL_ADAPTER_DIR", "artifacts/adapter"), get("LOCAL_MODEL_DEVICE", "auto"))


def text_input(spark: SparkSession, text: str | None = None, path: str | None = None) -> DataFrame:
    """input_id and text of exactly one of a text and a file."""
    if (text is None) == (path is None):
        raise ValueError("give a text or a file")
    rows = spark.createDataFrame([(text,)], "text string") if path is None else spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")
    return rows.select(F.lit(0).cast("long").alias("input_id"), "text")

"""Exports that appear whole or not at all, reports of one pass, and paths in any spelling."""

import json
import os

import pytest
from pyspark.sql import functions as F

from corvane.operators import metrics
from corvane.sources import sinks

CASE = "gold_category string, gold_signals array<string>, gold_issues array<string>, pred_category string, pred_signals array<string>, pred_issues array<string>, case_kind string, seconds double"


def chats(spark, mark=""):
    rows = [("train", f"a{mark}"), ("train", f"a{mark}"), ("validation", "b"), ("test", "c")]
    return spark.createDataFrame(rows, "split string, t string").select("split", F.array(F.struct(F.lit("user").alias("role"), F.col("t").alias("content"))).alias("messages"))


def names(folder):
    return sorted(p.name for p in folder.iterdir() if not p.name.endswith(".crc"))


def test_an_export_has_both_splits_and_a_manifest(spark, tmp_path):
    told = sinks.export_chats(chats(spark), str(tmp_path / "out"))
    assert names(tmp_path) == ["out"] and names(tmp_path / "out") == ["manifest.json", "train.jsonl", "valid.jsonl"]
    assert json.loads((tmp_path / "out/manifest.json").read_text()) == told and (told["train"]["lines"], told["valid"]["lines"]) == (2, 1)
    assert told["valid"]["bytes"] == len('{"messages":[{"role":"user","content":"b"}]}')
    assert sinks.export_problems(spark, str(tmp_path / "out")).count() == 0
    with pytest.raises(FileExistsError):
        sinks.export_chats(chats(spark), str(tmp_path / "out"))


def test_a_failure_between_the_splits_leaves_what_was_there(spark, tmp_path):
    def failing(rows, path):
        if path.endswith("valid.jsonl"):
            raise RuntimeError("lost")
        return sinks.written_split(rows, path)

    out = tmp_path / "out"
    with pytest.raises(RuntimeError):
        sinks.export_chats(chats(spark), str(out), write=failing)
    assert not out.exists() and len(names(tmp_path)) == 1  # what was staged
    first = sinks.export_chats(chats(spark), str(out))
    assert names(tmp_path) == ["out"]
    with pytest.raises(RuntimeError):
        sinks.export_chats(chats(spark, "2"), str(out), overwrite=True, write=failing)
    assert json.loads((out / "manifest.json").read_text()) == first and sinks.export_problems(spark, str(out)).count() == 0
    second = sinks.export_chats(chats(spark, "2"), str(out), overwrite=True)
    assert second["train"] != first["train"] and second["valid"] == first["valid"] and names(tmp_path) == ["out"]


def test_a_changed_lost_or_doubled_line_is_told(spark, tmp_path):
    for k, change in enumerate((lambda x: x.replace("a", "z", 1), lambda x: x.split("\n", 1)[1], lambda x: x + x)):
        out = tmp_path / f"out{k}"
        sinks.export_chats(chats(spark), str(out))
        part = next(p for p in (out / "train.jsonl").iterdir() if p.name.startswith("part-") and p.stat().st_size)
        part.write_text(change(part.read_text()))
        (out / f"train.jsonl/.{part.name}.crc").unlink(missing_ok=True)
        assert [r.name for r in sinks.export_problems(spark, str(out)).collect()] == ["train"]


def test_an_export_without_rows(spark, tmp_path):
    told = sinks.export_chats(chats(spark).where("split = 'test'"), str(tmp_path / "out"))
    assert {k: (v["lines"], v["bytes"]) for k, v in told.items()} == {"train": (0, 0), "valid": (0, 0)}
    assert sinks.export_problems(spark, str(tmp_path / "out")).count() == 0


def test_paths_are_compared_as_what_they_name(tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    (tmp_path / "link").symlink_to(data)
    same = [f"{data}/", f"{data}/.", f"{tmp_path}/x/../data", f"{tmp_path}//data", f"file:{data}", f"file://{data}", str(tmp_path / "link"), os.path.relpath(data)]
    for path in same:
        with pytest.raises(ValueError):
            sinks.guard_paths(str(data), export_dir=path)
        with pytest.raises(ValueError):
            sinks.guard_paths(str(data), report=f"{path}/test.jsonl")
    for store in ("hdfs://Host:9000/data", "HDFS://host:9000/data/../data/./", "hdfs://host:9000//data"):
        with pytest.raises(ValueError):
            sinks.guard_paths("hdfs://host:9000/data", export_dir=store)
    sinks.guard_paths("hdfs://host/data", export_dir="hdfs://other/data", report="hdfs://host/data/train.json")
    sinks.guard_paths(str(data), export_dir=f"{data}/out", report=f"{data}/report.json")


def test_a_report_is_one_pass_and_says_what_summarise_says(spark, tmp_path):
    rows = [("unknown", [], ["unsupported"], "unknown", [], ["invalid_model_output"], "unclear", 1.0), ("message", ["a"], [], "message", ["a", "b"], [], "ordinary", 2.0), (None, ["a"], [], "wifi", [], [], "ordinary", 4.5)]
    cases = spark.createDataFrame(rows, CASE)
    spark.sparkContext.setJobGroup("report", "report")
    told = sinks.write_report(cases, str(tmp_path / "r"), lambda m: m["valid_outputs"] > 2, {"gold_category": ("message", "wifi")})
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("report")) == 1
    spark.sparkContext.setJobGroup("other", "other")
    expected = metrics.summarise(cases).first().asDict()
    assert {k: told[k] for k in expected} == expected and told["passed"] is False
    assert [told[f"gold_category={x}"] for x in ("message", "wifi", "*")] == [1, 0, 2]
    assert spark.read.json(str(tmp_path / "r/metrics")).first().passed is False
    assert spark.read.json(str(tmp_path / "r/cases")).count() == 3
    assert sinks.write_report(cases.limit(0), str(tmp_path / "r"), True)["examples"] == 0

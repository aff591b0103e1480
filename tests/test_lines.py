"""Line numbers and fingerprints of files that many tasks read."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corvane.sources import catalog, lines


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "997", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def random_lines(n, seed):
    rng = random.Random(seed)
    return ["x" * rng.choice([0, 0, 1, 5, 40, 40, 700, 2500]) + f" é{k}" * rng.randrange(2) for k in range(n)]


def tree(values, fan_out):
    nodes = [hashlib.sha256(v.encode()).hexdigest() for v in values]
    while True:
        nodes = [hashlib.sha256("".join(nodes[i : i + fan_out]).encode()).hexdigest() for i in range(0, len(nodes), fan_out)]
        if len(nodes) <= 1:
            return nodes[0]


@pytest.mark.parametrize("end, last", [("\n", True), ("\n", False), ("\r\n", True), ("\r\n", False)])
def test_one_file_in_many_tasks(spark, tmp_path, small_splits, end, last):
    values = random_lines(400, len(end) + last)
    values[-1] = "the last"
    (tmp_path / "big.txt").write_bytes((end.join(values) + (end if last else "")).encode())
    assert spark.read.text(str(tmp_path / "big.txt")).rdd.getNumPartitions() >= 8
    assert lines.block_lines(spark, {"": str(tmp_path / "big.txt")}).select("block").distinct().count() >= 8
    got = sorted(tuple(r) for r in lines.read_lines(spark, str(tmp_path / "big.txt")).collect())
    assert got == list(enumerate(values, 1))


def test_line_ends_on_the_edges_of_splits(spark, tmp_path, small_splits):
    """Lines of every length around a split's, so that \\r and \\n fall on either side of an edge."""
    values = ["y" * (997 * 2 - 4 + k) for k in range(8)] + ["", ""] + ["z" * (995 - k) for k in range(6)]
    (tmp_path / "edges.txt").write_bytes("\r\n".join(values).encode())
    assert sorted(tuple(r) for r in lines.read_lines(spark, str(tmp_path / "edges.txt")).collect()) == list(enumerate(values, 1))


def test_a_folder_is_numbered_through_and_empty_files_have_no_lines(spark, tmp_path, small_splits):
    rows = spark.range(3000).select(F.format_string("%06d some text", "id").alias("value"))
    rows.repartitionByRange(5, "value").sortWithinPartitions("value").write.text(str(tmp_path / "out"))
    (tmp_path / "none.txt").write_text("")
    got = lines.numbered_lines(spark, {"out": str(tmp_path / "out"), "none": str(tmp_path / "none.txt")})
    assert sorted(tuple(r) for r in got.collect()) == [("out", k + 1, f"{k:06d} some text") for k in range(3000)]


@pytest.mark.parametrize("n, fan_out", [(1, 4), (4, 4), (5, 4), (300, 7), (343, 7), (344, 7)])
def test_trees_of_digests(spark, tmp_path, small_splits, n, fan_out):
    values = random_lines(n, n)
    values[-1] = "end"
    (tmp_path / "a.jsonl").write_text("\n".join(values) + "\n")
    (tmp_path / "b.jsonl").write_text("one line")
    named = {x: str(tmp_path / f"{x}.jsonl") for x in "ab"}
    got = {r.name: (r.lines, r.fingerprint) for r in lines.tree_fingerprints(lines.numbered_lines(spark, named), fan_out).collect()}
    assert got == {"a": (n, tree(values, fan_out)), "b": (1, tree(["one line"], fan_out))}


def test_examples_and_their_trees_know_a_changed_line(spark, tmp_path, small_splits):
    for split in ("train", "validation", "test"):
        (tmp_path / f"{split}.jsonl").write_text("".join('{"id": "%s-%d"}\r\n' % (split, k) for k in range(120)) + "no json\r\n")
    rows = catalog.load_examples(spark, str(tmp_path))
    assert {(r.split, r.line) for r in rows.where("problem = 'not json'").collect()} == {(s, 121) for s in ("train", "validation", "test")}
    assert rows.where("problem IS NULL").selectExpr("id = concat(split, '-', line - 1) AS ok").where("ok").count() == 360
    recorded = catalog.split_trees(spark, str(tmp_path)).collect()
    (tmp_path / "test.jsonl").write_text((tmp_path / "test.jsonl").read_text().replace("test-77", "test-7x"))
    found = catalog.fingerprint_mismatches(catalog.split_trees(spark, str(tmp_path)), spark.createDataFrame(recorded)).collect()
    assert [r.split for r in found] == ["test"]

"""Catalogs of very many entries: one a line, with their files as rows."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from corvane.plans.registry import QUERIES
from corvane.sources import catalog

ARTICLE = '<main id="main-content"><article class="node--view-mode-cfg-default"><div class="field--name-body"><p>%s</p></div></article></main>'


def test_packed_and_single_files_are_one_catalog(spark, tmp_path):
    kinds = [("a", "authored_summary", "in/a.txt"), ("b", "original_html", "b.html"), ("c", "authored_summary", "no.txt"), ("d", "authored_summary", "b.html"), ("e", "original_html", "in/e.html"), ("f", "authored_summary", "f.pdf"), ("g", "authored_summary", "g.txt")]
    lines = [json.dumps({"id": n, "title": n, "source_type": kind, "file": f, "tags": ["t"], "sources": [{"url": "u"}]}) for n, kind, f in kinds]
    (tmp_path / "catalog.jsonl").mkdir()
    for part in (1, 0):  # the order of the parts' names counts
        (tmp_path / f"catalog.jsonl/part-0000{part}.json").write_text("\n".join(lines[4:] if part else lines[:4]) + "\n")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text(" Single. \n")
    packed = [("b.html", ARTICLE % "Packed."), ("in/e.html", ARTICLE % "Too."), ("f.pdf", "no text"), ("g.txt", None)]
    spark.createDataFrame(packed, "path string, content string").write.parquet(f"{tmp_path}/packed.parquet")
    got = [(r.ordinal, r.doc_id, r.text, r.problem) for r in catalog.load_documents(spark, str(tmp_path)).collect()]
    assert got == [
        (0, "a", "Single.", None), (1, "b", "Packed.", None), (2, "c", None, "missing file"), (3, "d", None, "unsupported source"), (4, "e", "Too.", None), (5, "f", None, "missing file"), (6, "g", None, "empty document"),
    ]


def test_pages_are_no_file_each(spark, tmp_path):
    pages = spark.range(1, 401).select(F.col("id").alias("page_id"), F.concat(F.lit("u"), "id").alias("url"), F.concat(F.lit(" text\n"), "id", F.lit("\n")).alias("html"))
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("catalog-*"))
    got = {r.doc_id: r for r in QUERIES["catalog_documents"](spark, str(tmp_path)).collect()}
    assert len(got) == 400 and [got[str(k)].ordinal for k in (1, 2, 400)] == [0, 1, 399]
    assert [got[k].problem for k in ("7", "11", "12", "77")] == ["unsupported source", "missing file", None, "missing file"]
    (folder,) = set(shared.glob("catalog-*")) - before
    assert len([p for p in folder.rglob("*") if p.is_file()]) < 100

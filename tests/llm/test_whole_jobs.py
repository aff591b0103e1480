"""Queries do the whole job."""

from corvane.llm import queries
from tests.llm.helpers import frame, sha


def test_line_dedup_deletes_a_repeated_line_between_other_lines(spark, tmp_path):
    rows = [(1, "a\nboiler\nb"), (2, "c\nboiler\nd"), (3, "boiler"), (4, "e")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_runs, r.kept_sha256) for r in queries.QUERIES["op7_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: (3, 0, 0, sha("a\nboiler\nb")), 2: (3, 1, 1, sha("c\nd")), 3: (1, 1, 1, sha("")), 4: (1, 0, 0, sha("e"))}

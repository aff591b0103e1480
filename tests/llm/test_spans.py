import re

from corvane.llm import decontam, lines, pfp, secrets
from pyspark.sql import functions as F
from tests.llm.helpers import frame, lower, odd_texts, prose, sha

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(docs, items, window=10):
    words = {i: ALNUM.findall(lower(t)) for i, t in items}
    wins = [(i, tuple(w[k : k + min(window, len(w))])) for i, w in words.items() if w for k in range(len(w) - min(window, len(w)) + 1)]
    out = []
    for d, t in docs:
        w, hit, found = ALNUM.findall(lower(t)), set(), set()
        for i, x in wins:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    found.add(i)
        out.append((d, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=repr)


def test_decontamination_matches_brute_force(spark):
    rows = odd_texts()
    text = dict(r for r in rows if r[0] is not None)
    items = [(1, " ".join(text[1].split()[20:45])), (2, "ONE, two"), (3, None), (4, ""), (5, " ".join(text[11].split()[4000:4011])), (None, "same " * 12), (6, prose(15)), (10, "one two")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for most in (decontam.MOST_WINDOWS, 40, 7):  # one block, and several; the last has fewer windows than an item
        seen = decontam.scan(frame(spark, rows).withColumnRenamed("found", "other"), benchmark, most_windows=most)
        got = [(r.doc_id, r.found.n_words, r.hit, r.found["items"]) for r in seen.withColumn("hit", decontam.hit_words(F.col("found.spans"))).collect()]
        assert sorted(got, key=repr) == brute_hits(rows, items)


def test_blocks_have_no_more_windows_than_they_may_and_lose_none(spark):
    items = [(1, " ".join(f"w{i}" for i in range(100))), (2, "a b c"), (3, None), (4, " ".join(f"v{i}" for i in range(23)))]
    found = list(decontam.blocks(spark.createDataFrame(items, "item_id long, text string"), 10, "item_id", "text", 20))
    windows = [decontam.Block(x, 10).items for x in found]
    assert all(len(x) <= 20 for x in windows) and sum(map(len, windows)) == 91 + 1 + 14 == len(set().union(*windows))


def test_item_ids_of_any_type_are_sorted_as_strings(spark):
    benchmark = spark.createDataFrame([("b9", "one two"), ("b10", "two three"), (None, "three four")], "item_id string, text string")
    got = decontam.scan(frame(spark, [(1, "one two three four")]), benchmark).first().found
    assert got["items"] == ["b10", "b9"] and decontam.merged([tuple(x) for x in got.spans])[0][:2] == (0, 4)


def test_decontaminate_cuts_spans_or_drops_documents(spark):
    item = prose(20)
    rows = [(1, f"before {prose(60)} {item}, and after"), (2, item), (3, "clean text"), (4, None)]
    docs, benchmark = frame(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string")
    left = decontam.decontaminate(docs, benchmark)
    got = {r.doc_id: r.text for r in left.collect()}
    assert left.columns == docs.columns and set(got) == {1, 3, 4}
    assert item not in got[1] and got[1].startswith("before ") and got[1].endswith(", and after") and got[3] == "clean text"
    assert {r.doc_id for r in decontam.decontaminate(docs, benchmark, "documents").collect()} == {3, 4}
    assert decontam.decontaminate(docs, benchmark.limit(0)).count() == 4


def brute_repeats(rows, length):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        mark = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if raw[s : s + length] in seen:
                mark[s : s + length] = b"\1" * length
            else:
                seen.add(raw[s : s + length])
        runs = sum(1 for k in range(len(raw)) if mark[k] and (not k or not mark[k - 1]))
        out.append((i, len(raw), sum(mark), runs, sha(bytes(x for x, m in zip(raw, mark) if not m))))
    return out


def test_repeated_bytes_match_brute_force(spark, monkeypatch):
    rows = list({r[0]: r for r in odd_texts() if r[0] is not None}.values())
    digest = lambda found: found.select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
    for bits in (64, 3):  # with 3 bits, most keys stand for several phrases or windows
        got = sorted(tuple(r) for r in pfp.repeated_bytes(frame(spark, rows), result=digest, name_bits=bits).collect())
        assert got == brute_repeats(rows, pfp.LENGTH)


def test_phrases_cover_every_window_once_whatever_the_pieces(monkeypatch):
    import numpy as np
    import pyarrow as pa
    from corvane.llm.words import flat

    raw, at = flat(pa.array([t or "" for _, t in odd_texts()], pa.string()))
    whole = pfp.phrases(raw, at)
    monkeypatch.setattr(pfp, "PIECE", 300)
    cut = pfp.phrases(raw, at)
    for first, last, trigger, _ in (whole, cut):
        starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
        ends = np.repeat(at[1:], np.diff(at))
        assert (starts == np.flatnonzero(np.arange(len(raw)) + pfp.LENGTH <= ends)).all()
        assert ((trigger >= last) | (trigger >= first)).all() and (trigger + pfp.GRAM <= first + pfp.LENGTH).all()


def test_repeated_bytes_null_ids_versions_and_empty_table(spark):
    text = prose(60)
    rows = [(None, text), (3, text), (3, text + " more"), (3, text)]
    got = pfp.repeated_bytes(frame(spark, rows)).collect()
    assert len(got) == 4 and sum(r.n_removed == 0 for r in got) == 1 and [r.n_removed for r in got if r.doc_id is None] == [0]
    assert pfp.repeated_bytes(frame(spark, [])).count() == 0
    named = spark.createDataFrame([("b", text), ("a", text), ("c", "x")], "doc_id string, text string")
    assert sorted((r.doc_id, r.n_removed > 0) for r in pfp.repeated_bytes(named).collect()) == [("a", False), ("b", True), ("c", False)]


def brute_lines(rows, k):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        lines_ = (t or "").split("\n")
        gone = set()
        for s in range(len(lines_) - k + 1):
            run = tuple(lines_[s : s + k])
            if run in seen:
                gone |= set(range(s, s + k))
            seen.add(run)
        out.append((i, len(lines_), len(gone), "\n".join(x for n, x in enumerate(lines_) if n not in gone)))
    return out


def test_line_dedup_matches_brute_force(spark):
    head, foot = [prose(5) for _ in range(4)], [prose(4) for _ in range(3)]
    rows = [(1, "\n".join([*head, prose(6), *foot])), (2, "\n".join([prose(3), *head, *foot])), (3, "\n".join(head[:2] + ["x"] + head[2:])), (4, None), (5, ""), (6, "a\n\n\n\n\nb"), (7, "\n".join(["r"] * 50)), (8, head[0])]
    removed = F.aggregate("spans", F.lit(0), lambda t, x: t + x[1] - x[0])
    rows += [(9, "\n".join([*head, *foot, *head, "end"])), (10, "\n".join([*foot, *head, *foot, *head])), (11, "\n".join(f"l{i % 5}" for i in range(37)))]
    for k in (1, 2, 3, 7):
        got = sorted((r.doc_id, r.n_lines, r.gone, r.text) for r in lines.deduplicate_lines(frame(spark, rows), k).withColumn("gone", removed).collect())
        assert got == brute_lines(rows, k), k
    assert lines.deduplicate_lines(frame(spark, [])).count() == 0


def test_repeated_runs_are_maximal_and_have_an_earlier_copy(spark):
    """Every run is what its source has, goes on as far as both do, and starts earlier there."""
    import random

    rng = random.Random(9)
    blocks = [[f"b{i}.{j}" for j in range(rng.randrange(1, 20))] for i in range(6)]
    rows = [(i, "\n".join(x for _ in range(4) for x in rng.choice(blocks))) for i in range(12)] + [(20, "\n".join(["r"] * 33))]
    split = {i: t.split("\n") for i, t in rows}
    for k in (1, 2, 3, 7):
        runs = lines.repeated_runs(frame(spark, rows), k).collect()
        seen = set()
        for r in runs:
            a, b = split[r.doc_id], split[r.source.doc_id]
            i, j = r.at, r.source.at
            assert (r.source.doc_id, j) < (r.doc_id, i) and r.n >= k and a[i : i + r.n] == b[j : j + r.n]
            assert i + r.n == len(a) or j + r.n == len(b) or a[i + r.n] != b[j + r.n]
            seen |= {(r.doc_id, x) for x in range(i, i + r.n)}
        gone, known = set(), set()
        for i, t in sorted(rows):
            for at in range(len(split[i]) - k + 1):
                window = tuple(split[i][at : at + k])
                gone |= {(i, x) for x in range(at, at + k)} if window in known else set()
                known.add(window)
        assert seen == gone and max(r.n for r in runs) >= 19


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_secrets(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 32]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", text)]
    out += [(m.start(), 4, m.end()) for m in re.finditer(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", text) if len(m.group()) >= 24]
    out += [(m.start(), 5, m.end()) for m in re.finditer(r"[a-z][a-z0-9+.-]{0,20}://[^\x00-\x20/:@]{1,256}:([^\x00-\x20/:@]{1,256})@", text) if len(m.group(1)) >= 4]
    return ",".join(f"{('assign', 'access', 'hex', 'key', 'jwt', 'login')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets_match_brute_force_and_ledger_is_incremental(spark, tmp_path):
    rows = [*odd_texts(), (30, "é -----BEGIN RSA PRIVATE KEY-----\nab eyJhbGciOi.eyJzdWIiOi.c2lnbmF0dXJl at ftp://me:hunter22@host http://a:b@c")]
    docs = frame(spark, rows)
    path = f"{tmp_path}/ledger"
    ledger = secrets.update(docs, path)
    found = secrets.findings(docs, ledger, out="secrets_found")
    got = sorted(((r.doc_id, r.s) for r in found.select("doc_id", secrets.joined_spans(F.col("secrets_found")).alias("s")).collect()), key=repr)
    assert got == sorted(((i, brute_secrets(t or "")) for i, t in rows), key=repr)
    assert set(found.columns) == {*docs.columns, "secrets_found"}
    assert secrets.scan_unseen(docs, ledger).count() == 0
    newer = tuple(secrets.Rule(r.name, r.version + (r.name == "hex"), r.pattern, r.group, r.least) for r in secrets.RULES)
    again = secrets.scan_unseen(docs, ledger, newer)
    assert {(r.rule, r.version) for r in again.collect()} == {("hex", 2)}
    assert again.count() == len({t or "" for _, t in rows})
    assert secrets.findings(frame(spark, []), ledger).count() == 0


def test_a_later_snapshot_is_scanned_for_its_new_blobs_and_findings_reach_all_paths(spark, tmp_path):
    history = "path string, version int, text string"
    first = spark.createDataFrame([("a", 1, "token=abcdefgh1"), ("b", 1, "nothing"), ("c", 1, None)], history)
    second = spark.createDataFrame([("a", 2, "token=abcdefgh1 and more"), ("b", 1, "nothing"), ("d", 1, "token=abcdefgh1"), ("d", 1, "token=abcdefgh1")], history)
    path = f"{tmp_path}/ledger"
    kinds = len(secrets.RULES)
    assert secrets.update(first, path).count() == 3 * kinds
    assert {r.blob_id for r in secrets.scan_unseen(second, secrets.read_ledger(spark, path)).collect()} == {sha("token=abcdefgh1 and more")}
    ledger = secrets.update(second, path)
    assert ledger.count() == 4 * kinds
    got = secrets.findings(first.unionByName(second), ledger).select("path", "version", secrets.joined_spans(F.col("findings")).alias("s")).collect()
    spans = "assign:0:15"
    assert sorted((r.path, r.version, r.s) for r in got) == sorted([("a", 1, spans), ("b", 1, ""), ("c", 1, ""), ("a", 2, spans), ("b", 1, ""), ("d", 1, spans), ("d", 1, spans)])


def test_secrets_of_a_long_text_with_very_many_matches(spark, tmp_path):
    text = "token=abcdefgh1 x " * 40000 + "f" * 33
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = secrets.findings(docs, secrets.update(docs, f"{tmp_path}/ledger")).first().findings
    assert len(found["assign"]) == 40000 and found["assign"][-1] == [18 * 39999, 18 * 39999 + 15] and found["hex"] == [[720000, 720033]]

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import bpe, langid, licenses, lm
from tests.llm.helpers import blank_words, frame, odd_texts, prose

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encoding():
    return bpe.tokenizer(bpe.rank_file_bytes(PATH), PATTERN)


@pytest.mark.parametrize("text", ["", "a", "don't  stop\n\n now ", "ß 日本 🙂 é", "word " * 30000, "x" * 70000, "a1 b2\t\tc3 " * 9000, "one" + " " * 700 + "two" + "\n" * 600])
def test_cut_texts_give_the_ids_of_whole_texts(text):
    assert bpe.encode_text(text, encoding()) == encoding().encode_ordinary(text)
    assert "".join(p for p, _ in bpe.pieces(text, 100)) == text


def test_small_pieces_give_the_ids_of_whole_texts():
    e = encoding()
    for _, text in odd_texts():
        ids = [i for piece, single in bpe.pieces(text or "", 20) for i in (e._encode_single_piece(piece) if single else e.encode_ordinary(piece))]
        assert ids == e.encode_ordinary(text or "")


def test_very_long_blank_runs_are_encoded():
    text = "a" + " " * 300000 + "b" + "\n" * 200000
    ids = bpe.encode_text(text, encoding())
    assert encoding().decode_bytes(ids) == text.encode()


def test_round_trip_and_unknown_ids(spark):
    docs = frame(spark, odd_texts())
    both = bpe.round_trip(docs, PATH, PATTERN)
    apart = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN)
    key = lambda r: (repr(r.doc_id), r.text or "", tuple(r.ids), bytes(r.raw))
    assert sorted(map(key, both.collect())) == sorted(map(key, apart.collect()))
    assert all(bytes(r.raw) == (r.text or "").encode() for r in both.collect())
    odd = spark.createDataFrame([([1, 60000],), ([],), (None,)], "ids array<int>")
    assert [r.raw and bytes(r.raw) for r in bpe.decode(odd, PATH, PATTERN).collect()] == [None, b"", b""]


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7


def test_lm_base_matches_brute_force_and_model_matches_its_formula(spark):
    rows = odd_texts() + [(100 + i, prose(60)) for i in range(60)]
    column = F.when(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2, lm.HELD_OUT).when(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 3, lm.DELETED).otherwise(lm.KEPT)
    scores, sizes = lm.score_corpus(frame(spark, rows).withColumn("fold", column))
    tokens = [(i, [*blank_words(t), None]) for i, t in rows]
    uni = Counter(w for i, ws in tokens if fold(i) != 2 for w in ws)
    n, v = sum(uni.values()), len(uni)
    assert (sizes.tokens, sizes.words) == (n, v)
    expected = sorted((repr(i), len(ws), sum(uni[w] > 0 for w in ws), round(sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)
    got = scores.collect()
    assert sorted((repr(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == expected
    assert all(r.score < 0 for r in got)
    held = [r for r in got if r.fold == lm.HELD_OUT and r.n_tokens > 10]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_em_finds_the_mixture(spark):
    rng = np.random.default_rng(0)
    n = 40000
    kind = rng.choice(3, n, p=[0.5, 0.3, 0.2])  # each component explains its own events best
    ratios = [np.where(kind == 0, 2.0**20, 0.0), np.zeros(n), np.where(kind <= 1, 2.0**10, 0.0)]
    rows = [tuple(r.values()) for part in (slice(0, 100), slice(100, n)) for r in lm.event_row(np.full(n, lm.BUCKETS + 4)[part], [x[part] for x in ratios]).to_pylist()]
    w = lm.learn_weights(spark.createDataFrame(rows, lm.EVENTS), 3, 60)
    own = w[lm.BUCKETS + 4]
    assert abs(own.sum() - 1) < 1e-9 and abs(own[0] - 0.5) < 0.02 and own[1] < 0.001 and 0.2 < own[2] < 0.4 and 0.1 < own[3] < 0.3
    # buckets without events use what their context allows: two words and more, one word, none
    assert np.allclose(w.sum(axis=1), 1) and (w[lm.BUCKETS + 9] > 0).all() and w[7][0] == 0 < w[7][1] and w[0][:2].tolist() == [0, 0]
    assert lm.learn_weights(spark.createDataFrame([], lm.EVENTS), 3, tokens=0)[3].tolist() == [0, 0.5, 0, 0.5]
    assert lm.learn_weights(spark.createDataFrame([], lm.EVENTS), 3, tokens=0)[0].tolist() == [0, 0, 0, 1]


def plain_model(rows, folds, order, rounds=lm.ROUNDS):
    """Counts, EM and scores of deleted interpolation, token by token."""
    tokens = {i: ["<s>"] * (order - 1) + [*blank_words(t), "</s>"] for i, t in rows}
    levels = max(1, order - 1)

    def counted(parts):
        grams, contexts = [Counter() for _ in range(order)], [Counter() for _ in range(order)]
        for i, p in tokens.items():
            if folds[i] in parts:
                for at in range(order - 1, len(p)):
                    for k in range(order):
                        grams[k][tuple(p[at - k : at + 1])] += 1
                        contexts[k][tuple(p[at - k : at])] += 1
        return grams, contexts

    def looked_up(p, at, grams, contexts):
        bucket, e = 0, []
        for k in range(order - 1, 0, -1):
            c = contexts[k][tuple(p[at - k : at])]
            if c and not bucket:
                bucket = (k - 1) * lm.BUCKETS + c.bit_length()
            e.append(grams[k][tuple(p[at - k : at + 1])] / c if c else 0.0)
        n = sum(grams[0].values())
        return bucket, [*e, grams[0][(p[at],)] / max(n, 1)], 1 / (len(grams[0]) + 1)

    kept = counted({0})
    events = {}
    for i, p in tokens.items():
        if folds[i] == 1:
            for at in range(order - 1, len(p)):
                b, e, u = looked_up(p, at, *kept)
                events.setdefault(b, []).append([x / u for x in e] + [1.0])
    may = lm.allowed(order, int(bool(kept[0][0])))
    assert may.tolist() == [[order - k - 2 <= b // lm.BUCKETS and b > 0 for k in range(order - 1)] + [bool(kept[0][0]), True] for b in range(levels * lm.BUCKETS)]

    def round_of(w):
        shares, n, log = np.zeros(w.shape), np.zeros(len(w)), np.zeros(len(w))
        for b, rows_ in events.items():
            for e in rows_:
                total = sum(x * y for x, y in zip(w[b], e))
                log[b] += math.log(total)
                n[b] += 1
                for k in range(order + 1):
                    shares[b][k] += w[b][k] * e[k] / total
        return shares, n, log

    found, shares, n = lm.climb(round_of, may, rounds)
    if events:  # as likely as by many rounds without steps
        slow = may / may.sum(axis=1, keepdims=True)
        for _ in range(150):
            s, m, _ = round_of(slow)
            slow = lm.proper(np.where((m > 0)[:, None], s / np.maximum(m, 1)[:, None], slow), may)
        assert round_of(found)[2].sum() > round_of(slow)[2].sum() - 0.02
    w = {b: own.tolist() for b, own in enumerate(found)}
    for b in set(range(len(found))) - set(events):
        for pool in ([s for x, s in enumerate(shares) if x // lm.BUCKETS == b // lm.BUCKETS], list(shares)):
            mean = [sum(s[k] for s in pool) if may[b][k] else 0.0 for k in range(order + 1)]
            if sum(mean) > 0:
                mean = [max(x / sum(mean), lm.LEAST_WEIGHT) if m else 0.0 for x, m in zip(mean, may[b])]
                w[b] = [x / sum(mean) for x in mean]
                break
    full = counted({0, 1})
    scores = {}
    for i, p in tokens.items():
        scores[i] = 0.0
        for at in range(order - 1, len(p)):
            b, e, u = looked_up(p, at, *full)
            scores[i] += math.log10(sum(x * y for x, y in zip(w[b], [*e, u])))
    return scores, w, full


def small_corpus():
    import random

    rng = random.Random(11)
    words = "a b c d e f g h".split()
    rows = [(i, " ".join(rng.choice(words[: 2 + i % 7]) + rng.choice(["", "", "x"]) for _ in range(rng.randrange(0, 25)))) for i in range(60)]
    return [*rows, (60, None), (61, ""), (62, "entirely new words stand here")], {i: 2 if i == 62 else (0, 0, 1, 2, 0)[i % 5] for i in range(63)}


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_scores_match_plain_deleted_interpolation_with_learned_weights(spark, order):
    rows, folds = small_corpus()
    by_id = F.create_map(*[F.lit(x) for pair in folds.items() for x in pair])
    scores, _ = lm.score_corpus(frame(spark, rows).withColumn("fold", by_id[F.col("doc_id").cast("int")]), order=order)
    expected, _, _ = plain_model(rows, folds, order)
    got = {r.doc_id: r.score for r in scores.collect()}
    assert got.keys() == expected.keys() and all(got[i] == pytest.approx(expected[i], rel=1e-9, abs=1e-9) for i in got)


def test_lm_probabilities_of_all_words_sum_to_one_after_every_context():
    rows, folds = small_corpus()
    _, w, (grams, contexts) = plain_model(rows, folds, 3)
    words = [g[0] for g in grams[0]]
    n = sum(grams[0].values())
    for u, v in [("a", "b"), ("<s>", "<s>"), ("never", "seen"), ("never", "a"), ("<s>", "a")]:
        cv, cuv = contexts[1][(v,)], contexts[2][(u, v)]
        b = lm.BUCKETS + cuv.bit_length() if cuv else cv.bit_length() if cv else 0
        p = [w[b][0] * (grams[2][(u, v, x)] / cuv if cuv else 0) + w[b][1] * (grams[1][(v, x)] / cv if cv else 0) + w[b][2] * grams[0][(x,)] / n + w[b][3] / (len(words) + 1) for x in [*words, "unknown"]]
        assert sum(p) == pytest.approx(1, abs=1e-9)


def test_lm_takes_ids_of_any_type(spark):
    rows = [("b", "x y"), ("a", "x y z"), (None, "z")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumn("fold", F.lit(0))
    assert {(r.doc_id, r.n_tokens) for r in lm.score_corpus(docs)[0].collect()} == {("b", 3), ("a", 4), (None, 2)}


def test_lm_without_training_texts_and_empty_table(spark):
    scores, sizes = lm.score_corpus(frame(spark, [(1, "a b"), (2, None)]).withColumn("fold", F.lit(lm.HELD_OUT)))
    assert sizes.tokens == 0 and {(r.doc_id, r.n_tokens, r.base_score) for r in scores.collect()} == {(1, 3, 0.0), (2, 1, 0.0)}
    assert lm.score_corpus(frame(spark, []).withColumn("fold", F.lit(0)))[0].count() == 0


def languages():
    import random

    rng = random.Random(1)
    words = {"aa": "tak ruk mok lup".split(), "bb": "ola eni umi aso".split(), "cc": "strz przy chrz wsch".split()}
    return [(i, " ".join(rng.choice(words[lang]) + rng.choice(words[lang]) for _ in range(80)), lang) for i, lang in enumerate(sorted(words) * 30)]


def test_language_id_accuracy_and_odd_texts(spark):
    rows = languages()
    docs = frame(spark, rows)
    models = langid.fit(docs.where("doc_id % 4 <> 2"))
    assert set(models) == {"aa", "bb", "cc"} and all(len(x) <= langid.DICTIONARY_BYTES for x in models.values())
    seen = langid.identify(docs, models).where("doc_id % 4 = 2")
    assert seen.where("language.lang = lang AND NOT language.rejected").count() == seen.count() > 10
    odd = {r.doc_id: r.language for r in langid.identify(frame(spark, [(1, None), (2, ""), (3, "12 .. 34"), (4, "ola eni " * 40000)]), models).collect()}
    assert [odd[i].lang for i in (1, 2, 3)] == ["und"] * 3 and all(odd[i].rejected and odd[i].score == 0 for i in (1, 2, 3))
    assert odd[4].lang == "bb" and not odd[4].rejected and 0 <= odd[4].score <= 1
    assert langid.fit(frame(spark, [])) == {}
    assert {r.language.lang for r in langid.identify(docs, {}).collect()} == {"und"}
    assert langid.fit(frame(spark, [(None, prose(50), "aa"), (1, None, "bb"), (2, prose(50), None)]))  .keys() <= {"aa"}


def test_licences_headers_inheritance_and_odd_rows(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/one.py", "print()"), ("a/b/two.py", "x = 1\nLicensed under the Apache License, Version 2.0.\ny = 2"),
        ("a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("a/b/c/d/deep.c", "int x;"), ("other/file.txt", "nothing here"), ("other/LICENSE", None),
        ("plain.txt", "Licensed under CC BY-NC 4.0."), (None, "text"), ("a/b/one.py", "print()"), ("z/notes.md", "Licensed under CC BY-NC 4.0.\nand more"), ("z/y/x.md", ""),
    ]
    files = spark.createDataFrame([(*r, 1, "x") for r in rows], "path string, text string, depth int, term string")
    got = licenses.scan(files)
    found = {(r.path, *(r.found[k] for k in ("own_license", "license", "inherited_from"))) for r in got.collect()}
    assert got.count() == len(rows)
    assert found >= {
        ("a/LICENSE", "MIT", "MIT", None), ("a/b/one.py", None, "MIT", "a/LICENSE"), ("a/b/two.py", "Apache-2.0", "Apache-2.0", None), ("a/b/c/d/deep.c", None, "GPL-3.0", "a/b/c/COPYING"),
        ("other/file.txt", None, None, None), ("plain.txt", "CC-BY-NC-4.0", "CC-BY-NC-4.0", None), (None, None, None, None), ("z/notes.md", "CC-BY-NC-4.0", "CC-BY-NC-4.0", None), ("z/y/x.md", None, None, None),
    }
    assert licenses.scan(files.limit(0)).count() == 0


def wrapped(text, width=60):
    import textwrap

    return "\n".join(textwrap.wrap(" ".join(text.split()), width))


def found_licences(spark, rows):
    return {r.path: (r.found.own_license, r.found.license, r.found.inherited_from) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}


CODE = "\n".join(f"def helper_{i}(alpha, beta): yield alpha * {i} + gamma[beta]" for i in range(30))


def test_a_header_is_found_whatever_code_follows_and_licenses_its_own_file_only(spark):
    """Every template but one-line notices, on long lines, wrapped and as a comment, with 30 lines of code behind it or in the middle of them."""
    rows, expected = [], {}
    for k, (name, kind, text) in enumerate(licenses.TEMPLATES):
        if kind == licenses.LINE:
            continue
        for how, head in (("long", " ".join(text.split())), ("wrapped", wrapped(text)), ("comment", "/*\n" + "\n".join(" * " + x for x in wrapped(text).split("\n")) + "\n */")):
            for where, content in (("top", f"{head}\n{CODE}"), ("middle", f"{CODE}\n\n{head}\n{CODE}")):
                path = f"d{k}/{how}/{where}/a.py"
                rows += [(path, content), (f"d{k}/{how}/{where}/b.py", CODE), (f"d{k}/{how}/{where}/c/e.py", CODE)]
                expected[path] = name
    got = found_licences(spark, rows)
    right = sum(got[path][0] == name for path, name in expected.items())
    assert right >= 0.9 * len(expected), {p: (n, got[p]) for p, n in expected.items() if got[p][0] != n}
    assert right == len(expected)
    beginnings = {f"d{k}" for k, (_, kind, _) in enumerate(licenses.TEMPLATES) if kind == licenses.BEGINNING}  # a file that begins as a licence does is one
    assert all(got[p] == (None, None, None) for p, _ in rows if p not in expected and p.split("/")[0] not in beginnings)


def test_a_file_next_to_another_licence_keeps_its_own(spark):
    gpl = " ".join(licenses._GNU_HEADER.format(name="GNU General Public License", n=3).split())
    long_lines = gpl.replace(". ", ".\n")
    rows = [("p/a.py", "# Licensed under the Apache License, Version 2.0\n" + CODE), ("p/b.py", f"{long_lines}\n{CODE}"), ("p/c.py", CODE), ("p/q/r/d.py", CODE), ("x/unl.txt", licenses._UNLICENSE), ("x/y.py", CODE), ("x/LICENSE", licenses._UNLICENSE)]
    assert found_licences(spark, rows) == {
        "p/a.py": ("Apache-2.0", "Apache-2.0", None), "p/b.py": ("GPL-3.0", "GPL-3.0", None), "p/c.py": (None, None, None), "p/q/r/d.py": (None, None, None),
        "x/unl.txt": ("Unlicense", "Unlicense", None), "x/y.py": (None, "Unlicense", "x/LICENSE"), "x/LICENSE": ("Unlicense", "Unlicense", None),
    }


def test_recall_of_planted_licences(spark):
    """Whole texts and headers with changed names, lost lines and other layout, among files of prose and code: nine of ten at least, and nothing where there is none."""
    import random

    rng = random.Random(4)
    rows, expected = [], {}
    for k in range(240):
        name, kind, text = rng.choice([t for t in licenses.TEMPLATES if t[1] != licenses.LINE])
        lines = wrapped(text, rng.choice([40, 72, 100])).split("\n")
        if len(lines) > 6:
            del lines[rng.randrange(len(lines))]
        lines = [rng.choice(["# ", "// ", " * ", ""]) + x for x in lines]
        at = rng.randrange(len(lines) + 1)
        extra = [f"Copyright (c) {1990 + k % 30} Person Number {k}"] if rng.random() < 0.5 else []
        body = CODE.split("\n")[: rng.randrange(30)]
        rows.append((f"t{k}/f.c", "\n".join([*(extra if at else []), *lines, *body])))
        expected[f"t{k}/f.c"] = name
    plain = [(f"n{k}/f.txt", prose(300) if k % 2 else CODE) for k in range(120)]
    got = found_licences(spark, rows + plain)
    assert sum(got[p][0] == n for p, n in expected.items()) >= 0.9 * len(expected)
    assert all(got[p] == (None, None, None) for p, _ in plain)


def test_columns_of_any_name_come_back_unchanged(spark):
    from corvane.llm import secrets

    names = ["license", "own_license", "own_score", "inherited_from", "_dir", "_key", "findings", "blob_id", "content", "term", "place", "row", "key", "at"]
    schema = "path string, text string, " + ", ".join(f"{n} string" for n in names)
    rows = [(f"a/{k}", t, *[f"{n}{k}" for n in names]) for k, t in enumerate(["Released under the MIT License", "password=abcdefgh12", None])]
    table = spark.createDataFrame(rows, schema)
    got = licenses.scan(table)
    assert got.columns == ["path", *names, "found"] and sorted(tuple(r)[:-1] for r in got.collect()) == sorted((r[0], *r[2:]) for r in rows)
    seen = secrets.findings(table, secrets.scan_unseen(table), out="secrets")
    assert seen.columns == [*table.columns, "secrets"] and sorted(map(repr, (tuple(r)[:-1] for r in seen.collect()))) == sorted(map(repr, rows))
    with pytest.raises(ValueError, match="findings"):
        secrets.findings(table, secrets.scan_unseen(table))
    with pytest.raises(ValueError, match="license"):
        licenses.scan(table, out="license")


def test_licence_files_wrapped_headers_and_trees_of_directories(spark):
    texts = {(name, kind): text for name, kind, text in licenses.TEMPLATES}
    code = "\n".join(f"def f{i}(x): return x + {i}" for i in range(30))
    rows = [
        ("p/LICENSE", "MIT License\n\nCopyright (c) 2020 Some One\n\n" + wrapped(texts["MIT", licenses.WHOLE][12:])),
        ("p/src/a.py", code), ("p/src/deep/er/b.py", code + "\n"), ("p/src/deep/COPYING", "Copyright 1999 X\n" + wrapped(texts["BSD-3-Clause", licenses.WHOLE], 40)),
        ("p/src/apache.c", "/*\n" + wrapped(texts["Apache-2.0", licenses.HEADER].replace("TERMS AND CONDITIONS", "")) + "\n*/\n"),
        ("q/gpl2.c", wrapped(licenses._GNU_HEADER.format(name="GNU General Public License", n=2)) + "\n" + code[:80]),
        ("q/gpl3.c", wrapped(licenses._GNU_HEADER.format(name="GNU General Public License", n=3)) + "\n" + code[:80]),
        ("q/x/plain.c", code), ("q/notes.txt", "we talk of the license of cars and of permission to park " * 3), ("r/ISC", wrapped(texts["ISC", licenses.WHOLE])), ("r/s/t/u.txt", "words"),
        ("s/LICENSE", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nCopyright (C) 1989, 1991 Free Software Foundation, Inc.\nEveryone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed.\n\nPreamble\n"),
    ]
    got = found_licences(spark, rows)
    assert got == {
        "p/LICENSE": ("MIT", "MIT", None), "p/src/a.py": (None, "MIT", "p/LICENSE"), "p/src/deep/er/b.py": (None, "BSD-3-Clause", "p/src/deep/COPYING"), "p/src/deep/COPYING": ("BSD-3-Clause", "BSD-3-Clause", None),
        "p/src/apache.c": ("Apache-2.0", "Apache-2.0", None), "q/gpl2.c": ("GPL-2.0", "GPL-2.0", None), "q/gpl3.c": ("GPL-3.0", "GPL-3.0", None), "q/x/plain.c": (None, None, None), "q/notes.txt": (None, None, None),
        "r/ISC": ("ISC", "ISC", None), "r/s/t/u.txt": (None, "ISC", "r/ISC"), "s/LICENSE": ("GPL-2.0", "GPL-2.0", None),
    }


def test_licence_scores_match_a_plain_computation(spark):
    rows = [("a", "Released under the MIT License.\nfree text of the file"), ("b", "Licensed under the Apache License"), ("c", "the license of this work"), ("d", "This work is licensed under the GNU General Public License, version 3."),
            ("e/LICENSE", licenses._MIT), ("f", licenses._APACHE_HEADER.replace(". ", ".\n"))]
    files = spark.createDataFrame(rows, "path string, text string")
    idf, unknown = licenses.weights(files)
    vectors = licenses.vectors(idf)
    legal = {t for _, kind, notice in licenses.TEMPLATES if kind != licenses.LINE for t in licenses.python_terms(notice)}
    best = {}
    for path, text in rows:
        units = [(licenses.LINE, line) for line in text.split("\n")]
        run = []
        for line in [*(x for x in text.split("\n") if licenses.python_terms(x)), "\x00"]:
            own = set(licenses.python_terms(line))
            if own and 2 * len(own & legal) >= len(own):
                run.append(line)
                continue
            units += [(licenses.RUN, "\n".join(run[:n])) for n in {*(1 << j for j in range(10) if 1 << j < len(run)), len(run)} if run]
            run = []
        for kind, unit in units:
            own = Counter(licenses.python_terms(unit))
            x = {t: n * idf.get(t, unknown) for t, n in own.items()}
            norm = math.sqrt(sum(v * v for v in x.values())) or 1
            for (name, _, _), (of, vector, length) in zip(licenses.TEMPLATES, vectors, strict=True):
                score = sum(x.get(t, 0) * y for t, y in vector.items()) / norm / length
                if (licenses.LINE if of == licenses.LINE else licenses.RUN) == kind and score >= licenses.LEAST and score > best.get(path, ("", 0))[1] + 1e-9:
                    best[path] = (name, score)
    got = {r.path: (r.license, r.score) for r in licenses.declared(files).collect()}
    assert {k: (n, round(s, 6)) for k, (n, s) in got.items()} == {k: (n, round(s, 6)) for k, (n, s) in best.items()}


def test_exchange_totals_match_plain_counts_with_several_batches_a_bucket(spark):
    import pyarrow as pa

    from corvane.llm import exchange
    from corvane.llm.words import NOT_BLANK, Words

    texts = [prose(200) for _ in range(30)] + [None, ""]
    spark.conf.set("spark.corvane.batchChars", "2000")
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "3")
    try:
        corpus = exchange.Batches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        assert corpus.n > 3

        def send(table: pa.Table) -> pa.Table:
            keys, n = np.unique(Words(table["text"], NOT_BLANK).hashes(), return_counts=True)
            return exchange.forward_rows(table["b"][0].as_py(), [(keys, [n], 64, 5, 0)])

        def receive(table: pa.Table, replies: pa.Table) -> pa.Table:
            words = Words(table["text"], NOT_BLANK)
            keys = np.unique(words.hashes())
            got = exchange.read_totals(replies, 0, 5, 0)
            rows = [(words.word(k).decode(), int(got[np.searchsorted(keys, h)])) for k, h in enumerate(words.hashes())]
            return pa.table({"word": [r[0] for r in rows], "n": [r[1] for r in rows]}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

        replies = exchange.totals(corpus.each(send, exchange.FORWARD), 5).where("b >= 0")
        got = {(r.word, r.n) for r in corpus.replied(replies, receive, "word string, n long").collect()}
        corpus.drop()
    finally:
        spark.conf.unset("spark.corvane.batchChars")
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")
    assert got == set(Counter(w for t in texts for w in blank_words(t)).items())


def test_pieces_bound_what_is_worked_on_at_once():
    import pyarrow as pa

    from corvane.llm.batches import in_pieces

    texts = ["a" * 10, None, "b" * 35, "", "c" * 200, "d", "é" * 20, None]
    seen = []

    def lengths(part: pa.Array) -> pa.Array:
        seen.append(sum(len((x or "").encode()) for x in part.to_pylist()))
        return pa.array([len(x or "") for x in part.to_pylist()], pa.int64())

    for kind in (pa.string(), pa.large_string()):
        seen.clear()
        assert in_pieces(pa.array(texts, kind), lengths, 50).to_pylist() == [len(x or "") for x in texts]
        assert len(seen) > 1 and all(n <= 50 or n == 200 for n in seen)
    assert in_pieces(pa.array([], pa.string()), lengths).to_pylist() == [] and in_pieces(pa.array([None], pa.string()), lengths).to_pylist() == [0]


def test_the_callers_session_keeps_its_settings(spark):
    before = {k: v for k, v in spark.conf.getAll.items()}
    docs = frame(spark, [(1, "a b c"), (2, None)])
    bpe.encode(docs, PATH, PATTERN).collect()
    langid.identify(docs, {}).collect()
    lm.score_corpus(docs.withColumn("fold", F.lit(0)))[0].collect()
    assert {k: v for k, v in spark.conf.getAll.items()} == before

"""The registered query of each training-data operator: production parameters, whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, decontam, divergence, exact_dedup, jaccard, langid, licenses, lines, lm, minhash, pfp, secrets, vectors
from corvane.llm.batches import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int, key: str = "doc_id"):
    """crc32 of the key as text, modulo n; null keys count as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def vocabulary() -> tuple[str, str]:
    """(rank file, pre-splitting pattern) of the byte-level tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.when(remainder(7) == 2, lm.HELD_OUT).when(remainder(7) == 3, lm.DELETED).otherwise(lm.KEPT)
    scores, sizes = lm.score_corpus(table(spark, sf_dir, "documents").withColumn("fold", fold))
    return scores.select(
        "doc_id", (F.col("fold") == lm.HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(sizes.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


#: The rules that the ledger of op2 was begun with: the last of an earlier version, whose spans are in the ledger and not in the result.
EARLIER_RULES = tuple(secrets.Rule("hex", 0, r"[0-9a-f]{40,}", 0, 40) if r.name == "hex" else r for r in secrets.RULES)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{shared_dir(spark).rstrip('/')}/secret-ledger-{uuid.uuid4().hex}"
    secrets.update(docs, path, EARLIER_RULES)  # the ledger as it was before the rule for hex got its version 1
    ledger = secrets.update(docs, path)  # scans the blobs for that rule only
    found = secrets.findings(docs, ledger)
    spans, base = secrets.joined_spans(F.col("findings")), secrets.joined_spans(F.col("findings"), secrets.BASE_RULES)
    n = lambda kind: F.coalesce(F.size(F.col("findings")[kind]), F.lit(0)).cast("long")
    count = lambda kind: F.when(F.col("findings").isNull(), F.lit(0).cast("long")).otherwise(F.greatest(n(kind), F.lit(0).cast("long")))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.round_trip(docs, path, pattern)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    seen = decontam.scan(docs, table(spark, sf_dir, "benchmark"))
    n_hit = decontam.hit_words(F.col("found.spans"))
    items = F.array_join(F.array_sort("found.items"), ",")
    return seen.select(
        "doc_id", F.col("found.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op6_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda found: found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return pfp.repeated_bytes(table(spark, sf_dir, "documents"), result=digest)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.deduplicate_lines(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0), lambda total, x: total + x[1] - x[0]).cast("long")
    return found.select("doc_id", "n_lines", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_runs"), F.sha2("text", 256).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = langid.fit(docs.where(remainder(4) != 2))
    seen = langid.identify(docs.select("doc_id", "text"), models)
    return seen.select("doc_id", (remainder(4) == 2).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.margin").alias("margin"), F.col("language.rejected").alias("rejected"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folders = F.expr("slice(array(concat('part', doc_id div 1000), concat('box', doc_id div 20)), 1, cast(pmod(doc_id, 3) as int))")  # a tree of several levels
    letters = F.translate(F.col("doc_id").cast("string"), "0123456789", "abcdefghij")
    name = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("LICENSE."), letters)).otherwise(F.col("doc_id").cast("string"))  # one in five is named as a licence file
    path = F.concat_ws("/", F.lit(""), F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("und")), folders, name)
    found = licenses.scan(docs.select("doc_id", path.alias("path"), "text"))
    return found.select("doc_id", "path", "found.own_license", F.round("found.own_score", 6).alias("own_score"), "found.license", "found.inherited_from")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_components(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = vectors.encode(table(spark, sf_dir, "embeddings"))
    return vectors.with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(vectors.digest(codebooks)).alias("codebooks_sha256"))


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_secret_scan": op2_secret_scan,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_decontamination": op5_decontamination,
    "op6_repeated_bytes": op6_repeated_bytes,
    "op7_line_dedup": op7_line_dedup,
    "op8_language_id": op8_language_id,
    "op9_license_scan": op9_license_scan,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_minhash_dedup": op12_minhash_dedup,
    "op13_vector_codes": op13_vector_codes,
}

def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


NOTICES = ", ".join(f"({i}, '{name}', '{kind}', {quoted(notice)})" for i, (name, kind, notice) in enumerate(licenses.TEMPLATES))

def lloyd_sql(rounds: int = vectors.ROUNDS) -> str:
    """Codebooks by plain Lloyd rounds: every part meets every entry."""
    nearest = "SELECT vec_id, part, any_value(x) AS x, min((list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::HUGEINT * 256 + entry) AS m FROM p JOIN b{0} USING (part) GROUP BY vec_id, part"
    floored = "((s - (s % n + n) % n) // n)::DOUBLE"
    steps = ""
    for r in range(rounds):
        steps += f"""
             a{r} AS MATERIALIZED ({nearest.format(r)}),
             b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(u.c, b{r}.c) AS c FROM b{r} LEFT JOIN (
                 SELECT part, entry, list({floored} ORDER BY pos) AS c FROM (
                     SELECT part, (m % 256)::BIGINT AS entry, pos, sum(x[pos]::HUGEINT) AS s, count(*) AS n FROM (SELECT part, m, x, unnest(range(1, len(x) + 1)) AS pos FROM a{r}) GROUP BY ALL)
                 GROUP BY part, entry) u USING (part, entry)),"""
    return f"""
        WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             p AS MATERIALIZED (SELECT vec_id, part, e[part * len(e) // 4 + 1 : (part + 1) * len(e) // 4] AS x FROM (SELECT vec_id, e, unnest(range(4)) AS part FROM v)),
             b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 256)),{steps}
             f AS ({nearest.format(rounds)}),
             o AS (SELECT vec_id, string_agg(printf('%02x', (m % 256)::BIGINT), '' ORDER BY part) AS code, sum(m // 256)::BIGINT AS error FROM f GROUP BY vec_id),
             h AS (SELECT sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(c) AS y, generate_subscripts(c, 1) AS pos FROM b{rounds}))
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM o JOIN v USING (vec_id), h"""


ORACLES: dict[str, str] = {
    "op11_source_divergence": r"""
        WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
             t AS (SELECT lang, source, r, unnest(w) AS term FROM d),
             k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
             c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
             g AS (SELECT DISTINCT lang, source FROM d),
             dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
             p AS MATERIALIZED (SELECT lang, source, term, n, (1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER w + count(*) OVER w))::HUGEINT AS p FROM dense WINDOW w AS (PARTITION BY lang, source)),
             l AS (SELECT lang, term, (1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER w + count(*) OVER w))::HUGEINT AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) WINDOW w AS (PARTITION BY lang)),
             f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
             pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
             term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
        WHERE part = 'pair' OR rank <= 200""",
    "op13_vector_codes": lloyd_sql(),
    "op12_minhash_dedup": r"""
        WITH RECURSIVE w AS (
                 SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
             s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(3, len(w)) - 1], ' ') AS shingle
                   FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS overlap FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
             e AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * overlap >= 85 * (x.n + y.n - overlap)),
             r AS (SELECT a AS doc_id, a AS seen FROM (SELECT DISTINCT a FROM e) UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id, w.doc_id = coalesce(c.component_id, w.doc_id) AS kept
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)""",
    "op9_license_scan": f"""
        WITH d AS (SELECT doc_id, '/' || coalesce(source, 'unknown') || '/' || coalesce(lang, 'und') || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '/part' || doc_id // 1000 ELSE '/part' || doc_id // 1000 || '/box' || doc_id // 20 END AS dir,
                          CASE WHEN doc_id % 5 = 0 THEN 'LICENSE.' || translate(doc_id::VARCHAR, '0123456789', 'abcdefghij') ELSE doc_id::VARCHAR END AS name, coalesce(text, '') AS text FROM documents),
             t AS (SELECT * FROM (VALUES {NOTICES}) AS v(i, name, kind, notice)),
             tt AS (SELECT i, kind = 'line' AS one, term, count(*) AS tf FROM (SELECT i, kind, unnest(regexp_extract_all(lower(notice), '{licenses.TERM}')) AS term FROM t) GROUP BY ALL),
             df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '{licenses.TERM}')) AS term FROM d) WHERE term IN (SELECT term FROM tt) GROUP BY term),
             n AS (SELECT count(*) AS n FROM d),
             idf AS (SELECT term, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT term FROM tt) LEFT JOIN df USING (term), n),
             v AS (SELECT i, one, term, tf * idf AS y, sqrt(sum((tf * idf) ^ 2) OVER (PARTITION BY i)) AS length FROM tt JOIN idf USING (term)),
             legal AS (SELECT list(DISTINCT term) AS legal FROM tt WHERE NOT one),
             l AS (SELECT doc_id, place - 1 AS place, regexp_extract_all(lower(line), '{licenses.TERM}') AS terms
                   FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM d)),
             k AS (SELECT doc_id, terms, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS k FROM l WHERE len(terms) > 0),
             r AS (SELECT doc_id, terms, k, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM k, legal WHERE 2 * len(list_intersect(list_distinct(terms), legal)) >= len(list_distinct(terms))),
             p AS (SELECT doc_id, terms, min(k) OVER w AS start, row_number() OVER (PARTITION BY doc_id, run ORDER BY k) AS r, count(*) OVER w AS m FROM r WINDOW w AS (PARTITION BY doc_id, run)),
             u AS (SELECT doc_id, true AS one, place AS start, 1 AS size, terms FROM l
                   UNION ALL SELECT doc_id, false, start, unnest(list_append(list_filter(list_transform(range(0, 41), lambda j: (2 ^ j)::BIGINT), lambda s: s >= r AND s < m), m)), terms FROM p),
             lt AS (SELECT doc_id, one, start, size, term, count(*) AS tf FROM (SELECT doc_id, one, start, size, unnest(terms) AS term FROM u) GROUP BY ALL),
             w AS (SELECT doc_id, one, start, size, lt.term, tf, tf * coalesce(idf, ln(1 + n) + 1) AS x FROM lt LEFT JOIN idf USING (term), n),
             norm AS (SELECT doc_id, one, start, size, sum(x ^ 2) AS square, sum(tf) AS n_unit FROM w GROUP BY ALL),
             dot AS (SELECT doc_id, one, start, size, i, length, sum(x * y) AS dot FROM w JOIN v USING (one, term) GROUP BY ALL),
             sc AS (SELECT doc_id, i, start, n_unit, round(dot / sqrt(square) / length, 9) AS score FROM dot JOIN norm USING (doc_id, one, start, size) WHERE round(dot / sqrt(square) / length, 9) >= {licenses.LEAST}),
             judged AS (SELECT doc_id, score, i, (kind = 'whole' AND n_unit * 100 >= len(regexp_extract_all(lower(text), '{licenses.TERM}')) * {licenses.WHOLE_PERCENT}) OR (kind = 'beginning' AND start = 1) AS gives
                        FROM sc JOIN t USING (i) JOIN d USING (doc_id)),
             best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i, gives DESC) AS place FROM judged) WHERE place = 1),
             own AS (SELECT d.doc_id, dir || '/' || d.name AS path, dir, t.name, score, gives OR d.doc_id % 5 = 0 AS gives FROM best JOIN t USING (i) JOIN d USING (doc_id)),
             giver AS (SELECT dir, min(path) AS path, arg_min(name, path) AS name FROM own WHERE gives GROUP BY dir),
             up AS (SELECT dir, k, array_to_string(string_split(dir, '/')[1:k], '/') AS above FROM (SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS k FROM (SELECT DISTINCT dir FROM d))),
             near AS (SELECT up.dir, arg_max(giver.path, k) AS path, arg_max(giver.name, k) AS name FROM up JOIN giver ON up.above = giver.dir GROUP BY up.dir)
        SELECT d.doc_id, d.dir || '/' || d.name AS path, own.name AS own_license, round(own.score, 6) AS own_score, coalesce(own.name, near.name) AS license, CASE WHEN own.name IS NULL THEN near.path END AS inherited_from
        FROM d LEFT JOIN own ON own.doc_id = d.doc_id LEFT JOIN near ON near.dir = d.dir""",
    "op7_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
             f AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) > 1 AS gone FROM l),
             g AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS prior FROM f)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND NOT prior) AS n_runs,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM g GROUP BY doc_id""",
    "op10_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
             g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
        FROM n JOIN g ON n.norm = g.norm""",
    "op2_secret_scan": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
             m AS (
                 SELECT doc_id, 0 AS k, 8 AS least,
                        regexp_extract_all(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS found,
                        regexp_extract_all(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS part,
                        string_split_regex(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS gaps FROM t
                 UNION ALL
                 SELECT doc_id, 1, 16, regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0), string_split_regex(text, 'AKIA[A-Z0-9]+') FROM t
                 UNION ALL
                 SELECT doc_id, 2, 32, regexp_extract_all(text, '[0-9a-f]+', 0), regexp_extract_all(text, '[0-9a-f]+', 0), string_split_regex(text, '[0-9a-f]+') FROM t
                 UNION ALL
                 SELECT doc_id, 3, 1, regexp_extract_all(text, '-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----', 0), regexp_extract_all(text, '-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----', 0), string_split_regex(text, '-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----') FROM t
                 UNION ALL
                 SELECT doc_id, 4, 24, regexp_extract_all(text, 'eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+', 0), regexp_extract_all(text, 'eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+', 0), string_split_regex(text, 'eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+') FROM t
                 UNION ALL
                 SELECT doc_id, 5, 4, regexp_extract_all(text, '[a-z][a-z0-9+.-]{0,20}://[^\x00-\x20/:@]{1,256}:([^\x00-\x20/:@]{1,256})@', 0), regexp_extract_all(text, '[a-z][a-z0-9+.-]{0,20}://[^\x00-\x20/:@]{1,256}:([^\x00-\x20/:@]{1,256})@', 1), string_split_regex(text, '[a-z][a-z0-9+.-]{0,20}://[^\x00-\x20/:@]{1,256}:[^\x00-\x20/:@]{1,256}@') FROM t),
             u AS (SELECT doc_id, k, least, generate_subscripts(found, 1) AS i, unnest(found) AS x, unnest(part) AS y, unnest(gaps[1:len(found)]) AS gap FROM m WHERE len(found) > 0),
             o AS (SELECT *, sum(length(gap)) OVER w + coalesce(sum(length(x)) OVER (PARTITION BY doc_id, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
                   FROM u WINDOW w AS (PARTITION BY doc_id, k ORDER BY i)),
             s AS (SELECT doc_id, k, start::BIGINT AS a, (start + length(x))::BIGINT AS b FROM o WHERE length(y) >= least),
             j AS (SELECT doc_id, string_agg(['assign', 'access', 'hex', 'key', 'jwt', 'login'][k + 1] || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans,
                          string_agg(['assign', 'access', 'hex'][k + 1] || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k < 3) AS base,
                          count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex FROM s GROUP BY doc_id)
        SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM t LEFT JOIN j ON t.doc_id = j.doc_id""",
    "op4_jaccard_join": r"""
        WITH RECURSIVE w AS (
                 SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
             s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS shingle
                   FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS overlap FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
             e AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * overlap >= 80 * (x.n + y.n - overlap)),
             r AS (SELECT a AS doc_id, a AS seen FROM (SELECT DISTINCT a FROM e) UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)""",
    "op6_repeated_bytes": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
             w AS (SELECT doc_id, i, md5(h[2 * i + 1 : 2 * i + 200]) AS win FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d WHERE len(h) >= 200)),
             r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
             s AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true)::INT AS new FROM r),
             g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
             c AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, run),
             e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prior FROM c),
             k AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(d.h[2 * prior + 1 : 2 * a], '' ORDER BY a) || any_value(d.h)[2 * max(b) + 1 :] AS kept
                   FROM e JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, d.h))) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op5_decontamination": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower_ascii, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
                   FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
             b AS (SELECT item_id, list_filter(regexp_split_to_array(lower_ascii, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
                   FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM benchmark)),
             bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
                    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
             lens AS (SELECT DISTINCT n FROM bw),
             dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
                    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
             hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
             hw AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, n)) AS k FROM hit) GROUP BY doc_id),
             hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)""",
}

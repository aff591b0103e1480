"""The text functions under names for SQL: ``register(spark)``, then for instance SELECT chunk_text(text, 75) FROM t.
``chunk_text`` is a table function, too: SELECT ordinal, passage FROM t, LATERAL chunk_text(text, 75).

What is an expression becomes a SQL function, which Catalyst inlines; what needs order or
positions becomes an Arrow function.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, udtf

from corvane.functions.cues import all_cues
from corvane.functions.html import article_text
from corvane.functions.relevance import PRIZE_QUERY, PRIZES, REJECTED, SENTENCE_RULES
from corvane.functions.segment import passages_of, sentence_units
from corvane.functions.text import PASSAGE_STOP_WORDS, REDACTIONS, STOP_WORDS, exact_comparison_tokens, exact_unescape


def literal(text: str) -> str:
    return "r'" + text.replace("'", "\\u0027") + "'" if "'" in text else f"r'{text}'"


def words(values) -> str:
    return "array(" + ", ".join(f"'{x}'" for x in values) + ")"


def rewritten(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def redaction() -> str:
    x = "replace(exact_unescape(x), '<fone no>', '[PHONE]')"
    for pattern, instead in REDACTIONS:
        x = f"regexp_replace({x}, {literal('(?U)' + pattern)}, '{instead}')"
    return f"trim(regexp_replace({x}, r'(?U)\\s+', ' '))"


FOLDED = "replace(lower(x), 'ß', 'ss')"
RUNS = "regexp_extract_all({}, '[a-z0-9]+', 0)"
#: name: (type, body) of the functions of x.
EXPRESSIONS = {
    "search_terms": ("ARRAY<STRING>", f"array_except({RUNS.format(rewritten(FOLDED, (('wi-fi', 'wifi'), ('e-mail', 'email'), ('pop-up', 'popup'))))}, {words(STOP_WORDS)})"),
    "passage_terms": ("ARRAY<STRING>", f"transform(filter({RUNS.format(rewritten(FOLDED, (('wi-fi', 'wifi'), ('pop-up', 'popup'))))}, w -> NOT array_contains({words(PASSAGE_STOP_WORDS)}, w)), w -> if(length(w) > 4 AND w RLIKE '[^sui]s$', regexp_replace(w, 's$', ''), w))"),
    "dedup_key": ("STRING", f"trim(regexp_replace({FOLDED}, r'(?U)\\s+', ' '))"),
    "redacted": ("STRING", redaction()),
}


@arrow_udf(T.ArrayType(T.StringType()))
def chunk_text(texts: pa.Array, most_words: pa.Array) -> pa.Array:
    """Passages of at most so many words."""
    return pa.array([passages_of(t, n) for t, n in zip(texts.to_pylist(), most_words.to_pylist(), strict=True)], pa.list_(pa.string()))


@udtf(returnType="ordinal int, passage string")
class Passages:
    """The passages of a text as rows: FROM t, LATERAL chunk_text(text, 75), with a separator of paragraphs as third argument where it isn't an empty line."""

    def eval(self, text: str, most_words: int, separator: str = "\n\n"):
        yield from enumerate(passages_of(text, most_words, separator))


def relevance_body() -> str:
    """``relevance_score`` of (topic, sentence, query) as SQL."""
    like = lambda x, pattern: f"{x} RLIKE {literal('(?U)' + pattern)}"
    topics = ""
    for topic, rules in SENTENCE_RULES.items():
        whens = ""
        for points, must, also, never, least in rules:
            fits = [like("s", must), *([like("s", also)] if also else []), *([f"NOT {like('s', never)}"] if never else []), *([f"size(filter(split(s, r'(?U)\\s+'), w -> w <> '')) >= {least}"] if least else [])]
            whens += f" WHEN {' AND '.join(fits)} THEN {points}"
        topics += f" WHEN '{topic}' THEN CASE{whens} ELSE 0 END"
    prizes = f"{like('s', PRIZES)} AND NOT coalesce({like('query', PRIZE_QUERY)}, false)"
    points = f"transform(array(CASE topic{topics} ELSE 0 END), p -> CASE WHEN p = 0 OR {like('s', REJECTED)} OR ({prizes}) THEN 0 ELSE p END)[0]"
    return f"transform(array(lower(sentence)), s -> CASE WHEN s IS NULL THEN 0 ELSE {points} END)[0]"  # each element of an array is computed once


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; returns their names."""
    in_python = {"exact_unescape": exact_unescape, "chunk_text": chunk_text, "sentence_units": sentence_units(), "comparison_tokens": exact_comparison_tokens, "literal_cues": all_cues, "article_text": article_text()}
    for name, function in in_python.items():
        spark.udf.register(name, function)
    for name, (kind, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION relevance_score(topic STRING, sentence STRING, query STRING) RETURNS INT RETURN {relevance_body()}")
    spark.udtf.register("chunk_text", Passages)
    return [*in_python, *EXPRESSIONS, "relevance_score"]

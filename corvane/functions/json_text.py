"""JSON text with a blank after every comma and colon, and intervals inside it.

Spark's to_json writes no blanks; prompts, hashes and decision spans depend on them, so the
text is put together from its parts.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf


def quoted(text: Column) -> Column:
    """A JSON string; characters beyond ASCII stay as they are."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def listed(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def labelled(**parts: Column) -> Column:
    """An object whose values are JSON text already."""
    inner = [F.concat(F.lit(f'"{k}": '), v) for k, v in parts.items()]
    return F.concat(F.lit("{"), F.concat_ws(", ", *inner), F.lit("}"))


def observation_json(category: Column, signals: Column, issues: Column) -> Column:
    """{category, signals: [{signal, evidence}], issues} as one line of text."""
    pairs = F.transform(signals, lambda s: labelled(signal=quoted(s["signal"]), evidence=quoted(s["evidence"])))
    return labelled(category=quoted(category), signals=listed(pairs), issues=listed(F.transform(issues, quoted)))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat(system: str, text: Column, *answers: Column) -> Column:
    """system, user (the text as data in JSON) and assistant messages."""
    return F.array(message("system", F.lit(system)), message("user", labelled(input_text=quoted(text))), *[message("assistant", a) for a in answers])


# Fixed values: (pattern, group) of what a model decides in an observation's JSON text: names, the issues, where lists open, go on and close.
DECISIONS = (
    (r'"(?:category|signal)":\s*("[^"\\]*")', 1),
    (r'"issues":\s*(\[[^\]]*\])', 1),
    (r'"signals":\s*(\[)', 1),
    (r'(\]), "issues"', 1),
    (r'\}, \{"signal"', 0),
)


@arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def decision_spans(texts: pa.Array) -> pa.Array:
    """[from, to) of every decision, in characters, by place."""
    found = [sorted({m.span(group) for pattern, group in DECISIONS for m in re.finditer(pattern, x or "")}) for x in texts.to_pylist()]
    return pa.array([[list(span) for span in spans] for spans in found], pa.list_(pa.list_(pa.int32())))


def token_weights(tokens: Column, spans: Column, weight: float) -> Column:
    """``weight`` for tokens (structs of from and to) that overlap a span, 1 for others.

    The spans are the one element of an array here: an expression that stood inside the function of
    tokens would be computed for every token, and spans may be expressions over the whole text.
    """
    of = lambda known: F.transform(tokens, lambda t: F.when(F.exists(known, lambda s: (t["from"] < s[1]) & (t["to"] > s[0])), F.lit(float(weight))).otherwise(F.lit(1.0)))
    return F.transform(F.array(spans), of)[0]


def completion_start(prompt: Column, full: Column) -> Column:
    """Where the completion begins: the prompt's length, if the full ids begin with the prompt and go on; else null."""
    return F.when((F.slice(full, 1, F.size(prompt)) == prompt) & (F.size(full) > F.size(prompt)), F.size(prompt))


def strict_draft(text: str | None) -> tuple[str, int, bool] | None:
    """(source_id, sentence_id, insufficient_evidence) of one JSON object with just these keys and types; else None."""
    try:
        got = json.loads(text or "")
    except (ValueError, RecursionError):
        return None
    if not isinstance(got, dict) or set(got) != {"source_id", "sentence_id", "insufficient_evidence"}:
        return None
    source, sentence, nothing = got["source_id"], got["sentence_id"], got["insufficient_evidence"]
    if not isinstance(source, str) or type(sentence) is not int or not isinstance(nothing, bool):
        return None
    source = source.strip()
    return (source, sentence, nothing) if len(source) <= 20 and sentence >= 0 else None


DRAFT = T.StructType([T.StructField("source_id", T.StringType()), T.StructField("sentence_id", T.LongType()), T.StructField("insufficient_evidence", T.BooleanType())])


@arrow_udf(DRAFT)
def parsed_draft(texts: pa.Array) -> pa.Array:
    """A strict draft, or null."""
    rows = [strict_draft(x) for x in texts.to_pylist()]
    kind = pa.struct([("source_id", pa.string()), ("sentence_id", pa.int64()), ("insufficient_evidence", pa.bool_())])
    return pa.array([None if r is None else dict(zip(kind.names, r, strict=True)) for r in rows], kind)


def draft_outcome(draft: Column, source_id: Column, sentences: Column) -> Column:
    """answered, insufficient_evidence or invalid_citation, for a draft against the one source it was offered."""
    given = (draft["sentence_id"] != 0) | (draft["source_id"] != "")
    fits = (draft["source_id"] == source_id) & (draft["sentence_id"] > 0) & (draft["sentence_id"] <= F.size(sentences))
    return (
        F.when(draft.isNull(), "invalid_citation")
        .when(draft["insufficient_evidence"], F.when(given, "invalid_citation").otherwise("insufficient_evidence"))
        .when(F.coalesce(fits, F.lit(False)), "answered")
        .otherwise("invalid_citation")
    )

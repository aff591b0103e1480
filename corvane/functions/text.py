"""Column expressions over text: validity, search terms, comparison keys, redaction.

All stay in the JVM except where named ``exact_*``: those need Unicode case folding or
normalisation, which Spark's functions don't have, and run on Arrow batches.
"""

from __future__ import annotations

import html
import html.entities
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

MAX_CHARS = 4000
# Words that search terms and passage terms leave out, and words too general to select by.
STOP_WORDS = ("a", "an", "and", "for", "in", "is", "of", "on", "or", "the", "to")
PASSAGE_STOP_WORDS = STOP_WORDS + (
    "i", "my", "me", "you", "your", "it", "its", "this", "that", "these", "those", "are", "was", "were", "be", "been", "can", "could", "would", "should", "will",
    "have", "has", "had", "with", "from", "at", "by", "as", "but", "if", "then", "do", "does", "did", "about", "into", "says", "say", "saying", "now", "s",
)
GENERIC_TERMS = ("email", "internet", "ios", "iphone", "message", "network", "phone", "popup", "safari", "text", "wifi")
TRUSTED_HOSTS = ("consumer.ftc.gov", "support.apple.com")


def words(*values: str) -> Column:
    return F.array(*[F.lit(x) for x in values])


def reject_reason(text: Column) -> Column:
    """Why an input is not accepted (blank, too_long, control_characters); null if it is."""
    return (
        F.when(text.isNull() | ~text.rlike(r"(?U)[^\s\x1c-\x1f]"), "blank")
        .when(F.length(text) > MAX_CHARS, "too_long")
        .when(text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), "control_characters")
    )


def folded(text: Column) -> Column:
    """Lower case, with the sharp s as two letters: case folding for the languages at hand."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def search_terms(text: Column) -> Column:
    """The distinct words a document is selected by."""
    plain = folded(text)
    for a, b in (("wi-fi", "wifi"), ("e-mail", "email"), ("pop-up", "popup")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return F.array_except(F.regexp_extract_all(plain, F.lit("[a-z0-9]+"), F.lit(0)), words(*STOP_WORDS))


def passage_terms(text: Column) -> Column:
    """The words a passage is ranked by, with repeats; plurals lose their s."""
    plain = F.replace(F.replace(folded(text), F.lit("wi-fi"), F.lit("wifi")), F.lit("pop-up"), F.lit("popup"))
    kept = F.filter(F.regexp_extract_all(plain, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(*PASSAGE_STOP_WORDS))
    return F.transform(kept, lambda w: F.when((F.length(w) > 4) & w.rlike("[^sui]s$"), F.regexp_replace(w, "s$", "")).otherwise(w))


def dedup_key(text: Column) -> Column:
    """Case and every run of white space don't count."""
    return F.trim(F.regexp_replace(folded(text), r"(?U)\s+", " "))


def weak_key(text: Column) -> Column:
    """Case and white space at the ends don't count."""
    return F.regexp_replace(folded(text), r"(?U)^\s+|\s+$", "")


def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


def passage_id(doc_id: Column, ordinal: Column, text: Column) -> Column:
    """document:ordinal:first ten hex digits of the passage's SHA-256."""
    return F.concat_ws(":", doc_id.cast("string"), ordinal.cast("string"), F.substring(fingerprint(text), 1, 10))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def paragraphs_normalised(text: Column, separator: str = "\n\n") -> Column:
    """White space inside paragraphs as single spaces, blank paragraphs gone."""
    parts = F.transform(F.split(text, separator, -1), collapsed)
    return F.array_join(F.filter(parts, lambda p: p != ""), separator)


# What is redacted, in this order, and what stands in its place.
REDACTIONS = (
    (r"https?://\S+|www\.\S+", "https://source-link.example"),
    (r"\b[\w.+-]+@[\w.-]+\.[a-zA-Z]{2,}\b", "[EMAIL]"),
    (r"(?<!\d)0(?:[ ()-]*\d){10}", "[PHONE]"),
    (r"(?i)\b0\d+x+\b", "[PHONE]"),
    (r"(?<!\d)\d{5,}(?!\d)", "[NUMBER]"),
    (r"(?i)\b(?:po\s*box|pobox|box)\s*\d+[\w/]*", "[POSTBOX]"),
    (r"(?i)\b[a-z]{1,2}\d[a-z\d]?\s*\d[a-z]{2}\b", "[POSTCODE]"),
)


# A character reference that its semicolon ends.
CLOSED_REFERENCE = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")


def is_closed(reference: re.Match) -> bool:
    """Whether what stands between & and the semicolon is a number or a whole name; HTML also reads the beginning of a longer word as one."""
    return reference[1][0] == "#" or reference[1] + ";" in html.entities.html5


def unescape_closed(text: str) -> str:
    """HTML entities as characters, but only those that end in a semicolon: what is left of one that was cut off stays as it is."""
    return CLOSED_REFERENCE.sub(lambda m: html.unescape(m[0]) if is_closed(m) else m[0], text)


@arrow_udf(T.StringType())
def exact_unescape(texts: pa.Array) -> pa.Array:
    """HTML entities as characters."""
    return pa.array([x if x is None or "&" not in x else html.unescape(x) for x in texts.to_pylist()], pa.string())


@arrow_udf(T.StringType())
def exact_unescape_closed(texts: pa.Array) -> pa.Array:
    """``unescape_closed`` of a column."""
    return pa.array([x if x is None or "&" not in x else unescape_closed(x) for x in texts.to_pylist()], pa.string())


def redacted(text: Column, entities: bool = True, cut_entities: bool = True) -> Column:
    """Links, addresses, phone numbers, long numbers, post boxes and postcodes replaced. entities: decode HTML first (in Python); cut_entities: also those without a semicolon, as browsers do."""
    decoded = exact_unescape if cut_entities else exact_unescape_closed
    out = F.replace(decoded(text) if entities else text, F.lit("<fone no>"), F.lit("[PHONE]"))
    for pattern, instead in REDACTIONS:
        out = F.regexp_replace(out, "(?U)" + pattern, instead)
    return collapsed(out)


#: Characters of text that are Python objects at one time.
SLICE_CHARS = 1 << 20


def slices(texts: pa.Array, most: int = SLICE_CHARS) -> Iterator[pa.Array]:
    """A batch of texts in runs of rows of some ``most`` bytes, a longer text by itself; at least one run, which may be empty."""
    upto, begin = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)), 0
    while True:
        before = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, before + most, "right")))
        yield texts.slice(begin, end - begin)
        if end >= len(texts):
            return
        begin = end


@arrow_udf(T.ArrayType(T.StringType()))
def exact_comparison_tokens(texts: pa.Array) -> pa.Array:
    """Words for near-duplicate comparison: normalised and case-folded, links and numbers as one word each."""

    def one(text):
        if text is None:
            return None
        plain = unicodedata.normalize("NFKC", text).casefold()
        plain = re.sub(r"\b\d+(?:[.\-]\d+)*\b", "number", re.sub(r"https?://\S+", "url", plain))
        return re.findall(r"\w+", plain)

    return pa.concat_arrays([pa.array([one(x) for x in part.to_pylist()], pa.list_(pa.string())) for part in slices(texts)])


def trusted_urls(urls: Column) -> Column:
    """Whether there are links, all https to a trusted host."""
    return (F.size(urls) > 0) & F.forall(urls, lambda u: F.coalesce((F.try_parse_url(u, F.lit("PROTOCOL")) == "https") & F.try_parse_url(u, F.lit("AUTHORITY")).isin(*TRUSTED_HOSTS), F.lit(False)))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Rounded to four places; null where there is nothing to divide by."""
    return F.round(numerator / F.nullif(denominator, F.lit(0)), 4)


def without_fence(text: Column) -> Column:
    """The content of a ```json block that is the whole text."""
    plain = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(plain.rlike(r"(?s)^```json\n.*\n```$"), F.regexp_extract(plain, r"(?s)^```json\n(.*)\n```$", 1)).otherwise(plain)

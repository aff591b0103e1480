"""Language identification by compression.

Each language is a zstandard raw-content dictionary, made of a bounded sample of its
labelled texts. A text is compressed with every dictionary; the language whose dictionary
gives the fewest bytes wins. Texts and dictionaries are prepared alike: lower case, and
every run of characters that aren't letters as one space, so that case and layout do not
count. Texts are compressed in blocks of ``BLOCK`` bytes, and the sizes added up, so that the
dictionaries count as much at the end of a long text as at its beginning. ``margin`` is what
the second-best language needs more, as a share of the best; where it is below ``NARROW``
the result is marked as rejected. Equal sizes go to the language that is first in order of
name.

Null texts and texts without a letter: ``und``, score 0, rejected. With no labelled text at
all, every text is ``und``. Labels are compared as they are; null labels are not learned, null ids
are learned like others. Repeated rows are learned once and have results of their own. Only the
struct column named by the caller is added; extra columns stay.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window
from pyspark.sql.functions import arrow_udf

from corvane.llm.batches import release, send_package

#: The sample: so many labelled rows of a language at most, and so many bytes of them.
ROWS_A_LANGUAGE = 96
DICTIONARY_BYTES = 64 << 10
#: The sample of a language is chosen from the samples of so many parts of its rows.
SLOTS = 64
#: Rows of such lengths are taken first.
FIT_CHARS = (200, 8000)
LEVEL = 6
BLOCK = 16 << 10
#: Reject where the second language needs less than this share more.
NARROW = 0.004

NO_LETTERS = re.compile(r"[\W\d_]+")
RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def prepared(text: str) -> str:
    return NO_LETTERS.sub(" ", text.lower()).strip()


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = ROWS_A_LANGUAGE, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A dictionary for each language, from at most ``rows`` rows of it, chosen by a hash of key and text.

    The driver gets the hashes of the chosen rows, then their texts, each once however often the
    row is repeated.
    """
    usable = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    slim = usable.select(F.col(lang).alias("lang"), F.xxhash64(key, text).alias("h"), (~F.length(text).between(*FIT_CHARS)).cast("int").alias("odd")).distinct()
    for groups in (["lang", "slot"], ["lang"]):  # first in slots, so that no task gets rows from all others, whatever language most rows have
        order = Window.partitionBy(*groups).orderBy("odd", "h")
        slim = slim.withColumn("slot", F.pmod("h", F.lit(SLOTS))).withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows).drop("n")
    chosen = slim.collect()
    odd = {(r["lang"], r["h"]): r["odd"] for r in chosen}
    found: dict[str, list] = {}
    if odd:
        sample = usable.select(F.col(lang).alias("lang"), F.xxhash64(key, text).alias("h"), F.substring(text, 1, 2 * size).alias("text"))
        for r in sample.where(F.col("h").isin(sorted({h for _, h in odd}))).distinct().toLocalIterator():
            if (r["lang"], r["h"]) in odd:
                found.setdefault(r["lang"], []).append((odd[r["lang"], r["h"]], r["h"], r["text"]))
    return {name: " ".join(prepared(x) for _, _, x in sorted(own)).encode()[:size] for name, own in found.items()}


@lru_cache(4)
def compressors(dictionaries: tuple[tuple[str, bytes], ...], level: int):
    import zstandard

    out = []
    for name, raw in dictionaries:
        if len(raw) >= 8:
            content = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            out.append((name, zstandard.ZstdCompressor(level=level, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return out


def classify(text: str | None, models: list, narrow: float = NARROW) -> dict:
    """lang, score from 0 to 1, margin, and whether the margin is too narrow."""
    plain = prepared(text) if text else ""
    raw = f" {plain} ".encode()  # the spaces let whole words match at the ends of very short texts
    if not models or not any(map(str.isalpha, plain)):
        return {"lang": "und", "score": 0.0, "margin": 0.0, "rejected": True}
    blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
    sizes = sorted((sum(len(model.compress(x)) for x in blocks), name) for name, model in models)
    best = sizes[0][0]
    margin = (sizes[1][0] - best) / best if len(sizes) > 1 else 1.0
    # code lengths as probabilities, per byte of the best code: 1 / (1 + sum of 2^-(extra share x 64))
    score = 1.0 / sum(2.0 ** (-64.0 * (n - best) / best) for n, _ in sizes)
    return {"lang": sizes[0][1], "score": score, "margin": margin, "rejected": margin < narrow}


def identify(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text", out: str = "language", narrow: float = NARROW, level: int = LEVEL) -> DataFrame:
    """``df`` with the struct ``out``: lang, score, margin, rejected. Only the text is looked at."""
    send_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(tuple(sorted(dictionaries.items())))

    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_())])

    @arrow_udf(RESULT)
    def run(texts: pa.Array) -> pa.Array:
        models = compressors(shared.value, level)
        found = pa.array([classify(x.as_py(), models, narrow) for x in texts], kind)
        release()
        return found

    return df.withColumn(out, run(F.col(text)))

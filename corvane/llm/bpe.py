"""Byte-level BPE: encoding whole texts by a local rank file, and decoding ids to raw bytes.

tiktoken does the merges. Its matcher recurses on long runs, so long texts are first cut
where no match of the pre-splitting pattern can lie across the cut:

- before a space or newline that follows a letter: only the first character of a match can
  be a space in front of something else, and no match has a letter before white space;
- long runs of white space are pieces by themselves, without their last character if text
  follows, which is what ``\\s+(?!\\S)`` takes.

Nulls, empty texts: no ids, which decode to no bytes. Ids that are not in the rank file:
decode to null (the whole row). Repeated rows and rows that share an id have results of their own,
empty tables none. Extra columns stay; a column of the output's name is replaced.
"""

from __future__ import annotations

import base64
import itertools
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from corvane.llm.batches import in_pieces, send_package

#: The largest rank file that is sent to executors.
MOST_RANK_BYTES = 64 << 20
#: Texts longer than this are cut at safe boundaries, each piece at about this length.
PIECE_CHARS = 1 << 16
#: Runs of white space of this length are encoded as pieces of their own.
LONG_BLANK = 512

#: The characters that the pattern's \s stands for.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK_RUN = re.compile(f"[{BLANK}]{{{LONG_BLANK},}}")
SAFE = re.compile(r"[^\W\d_](?=[ \n])")


@lru_cache(4)
def tokenizer(rank_file: bytes, pattern: str):
    """A tiktoken encoding from the lines ``base64(bytes) rank``."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines()) if token}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS):
    """(piece, whether it is one match by itself): together the text, cut at safe boundaries only."""
    at = 0
    for run in BLANK_RUN.finditer(text):
        last = run.end() if run.end() == len(text) else run.end() - 1
        yield from ((x, False) for x in plain_pieces(text[at : run.start()], size))
        yield text[run.start() : last], True
        at = last
    yield from ((x, False) for x in plain_pieces(text[at:], size))


def plain_pieces(text: str, size: int):
    at = 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size - 1)
        if not cut:
            break
        yield text[at : cut.end()]
        at = cut.end()
    if at < len(text):
        yield text[at:]


def encode_text(text: str | None, encoding) -> list[int]:
    """The ids of one whole text."""
    if not text:
        return []
    if len(text) <= LONG_BLANK:
        return encoding.encode_ordinary(text)
    ids: list[int] = []
    for piece, single in pieces(text):
        ids += encoding._encode_single_piece(piece) if single else encoding.encode_ordinary(piece)
    return ids


def rank_file_bytes(path: str) -> bytes:
    """The rank file's content, if it is small enough to broadcast."""
    size = Path(path).stat().st_size
    if size > MOST_RANK_BYTES:
        raise ValueError(f"{path} has {size} bytes; at most {MOST_RANK_BYTES} are sent to executors")
    return Path(path).read_bytes()


def id_array(lists: list[list[int]]) -> pa.Array:
    """Lists of ids as an Arrow array, without an object for each id."""
    flat = np.fromiter(itertools.chain.from_iterable(lists), dtype=np.int32, count=sum(map(len, lists)))
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def decode_ids(ids: list[int] | None, encoding) -> bytes | None:
    """The bytes of a list of ids; none for null, and null for an unknown id."""
    try:
        return encoding.decode_bytes(ids or [])
    except KeyError:
        return None


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the array column ``ids`` of token ids of the whole text."""
    send_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(rank_file_bytes(rank_file))

    @arrow_udf(T.ArrayType(T.IntegerType()))
    def to_ids(texts: pa.Array) -> pa.Array:
        encoding = tokenizer(shared.value, pattern)
        return in_pieces(texts, lambda some: id_array([encode_text(x.as_py(), encoding) for x in some]))

    return df.withColumn(ids, to_ids(F.col(text)))


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", raw: str = "raw") -> DataFrame:
    """``df`` with the binary column ``raw``: the bytes that the ids stand for, whether or not they are valid UTF-8."""
    send_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(rank_file_bytes(rank_file))

    @arrow_udf(T.BinaryType())
    def to_bytes(arrays: pa.Array) -> pa.Array:
        encoding = tokenizer(shared.value, pattern)
        return pa.array([decode_ids(x.values.to_numpy().tolist() if x.is_valid else None, encoding) for x in arrays], pa.binary())

    return df.withColumn(raw, to_bytes(F.col(ids)))


def round_trip(df: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids", raw: str = "raw") -> DataFrame:
    """``df`` with both columns, as ``decode(encode(df))`` gives them, in one pass: each text is encoded once, and its ids decoded."""
    send_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(rank_file_bytes(rank_file))
    both = "_corvane_both"

    @arrow_udf(T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("raw", T.BinaryType())]))
    def run(texts: pa.Array) -> pa.Array:
        encoding = tokenizer(shared.value, pattern)

        def some(part: pa.Array) -> pa.Array:
            lists = [encode_text(x.as_py(), encoding) for x in part]
            return pa.StructArray.from_arrays([id_array(lists), pa.array([decode_ids(x, encoding) for x in lists], pa.binary())], ["ids", "raw"])

        return in_pieces(texts, some)

    return df.withColumn(both, run(F.col(text))).withColumns({ids: F.col(f"{both}.ids"), raw: F.col(f"{both}.raw")}).drop(both)

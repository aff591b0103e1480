"""Counting keys of a corpus by batches, so that no key can be a hot spot.

A corpus is dealt into batches of a few MB of text and written once as a bucketed table in
the shared folder, so that every later pass reads whole batches without a shuffle. A pass over
the batches sends each distinct key of a batch once, with the batch's own counts, to the
part that its hash belongs to; the part adds up what the batches sent and replies to every
batch, in the order of the batch's sorted keys. A key that is in a third of all rows arrives
at most once from each batch, and replies hold no keys.

A worker holds one batch or one part at a time. The number of parts follows from the number of
keys alone, so a part has ``PART_KEYS`` keys on average whatever the corpus; a very frequent key
adds one entry a batch. Equal rows are spread over batches by the partition they were read from.

Keys travel as sorted differences, byte plane by byte plane, compressed: most of a 64-bit
hash's bits are in the difference, so fewer bits of hash make less to move.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.batches import delete, release, shared_dir, shuffles_end

#: Characters of text in a batch, and keys in a part: what one Python worker holds at once (some 100 MB).
#: Rows that are sent are batches x parts at most, and keys at most: a larger corpus wants larger ones, as
#: far as workers have memory, by the settings spark.corvane.batchChars and spark.corvane.partKeys.
BATCH_CHARS = 4_000_000
PART_KEYS = 500_000
#: Keys are dealt by so many of their highest bits.
SLOT_BITS = 24

FORWARD = "b long, part int, keys binary, values array<binary>"
REPLY = "b long, part int, totals array<binary>, stats array<long>"
_FORWARD = pa.schema([("b", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), ("values", pa.list_(pa.binary()))])
_REPLY = pa.schema([("b", pa.int64()), ("part", pa.int32()), ("totals", pa.list_(pa.binary())), ("stats", pa.list_(pa.int64()))])


def pack(a: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(raw: bytes, kind) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, len(flat) // size).T).view(kind).ravel()


def pack_counts(a: np.ndarray) -> bytes:
    """Counts in the narrowest width that holds them all, which the first byte tells."""
    size = next(k for k in (1, 2, 4, 8) if not len(a) or int(a.max()) < 1 << (8 * k))
    return bytes([size]) + pack(a.astype(f"u{size}"))


def unpack_counts(raw: bytes) -> np.ndarray:
    return unpack(raw[1:], f"u{raw[0]}").astype(np.int64)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.zeros(1, keys.dtype)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, np.uint64), dtype=np.uint64)


def slices(keys: np.ndarray, bits: int, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of sorted keys of ``bits`` bits, dealt by their highest bits; parts without keys are left out."""
    part = (keys >> np.uint64(bits - SLOT_BITS)).astype(np.int64) * parts >> SLOT_BITS
    begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    return zip(part[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(part)], strict=len(part) > 0)


def key_bits(keys: int, spare: int) -> int:
    """So many bits that a given key clashes with any of ``keys`` others with probability 2^-spare at most."""
    return min(64, max(24, math.ceil(math.log2(max(keys, 2))) + spare))


class Batches:
    """A corpus in batches; ``drop()`` removes the table when the results are written.

    With ``code``, a function from a batch's rows to what later passes need of them and its
    schema, the table holds that in the place of the texts.
    """

    def __init__(self, df: DataFrame, text: str = "text", code: tuple[Callable[[pa.Table], pa.Table], str] | None = None):
        self.spark = df.sparkSession
        chars = self.setting("spark.corvane.batchChars", BATCH_CHARS)
        total = df.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]  # characters, or bytes of binary texts
        least = self.setting("spark.sql.shuffle.partitions", 200)
        self.chars, self.n = total, max(1, least, -(-total // chars))
        self.name = f"corvane_batches_{uuid.uuid4().hex}"
        buckets = min(self.n, self.setting("spark.sql.sources.bucketing.maxBuckets", 100_000))  # then some hold several batches
        # equal rows are told apart by the partition they come from, which a task that runs again finds the same
        dealt = df.withColumn("b", F.pmod(F.xxhash64("doc_id", text, F.spark_partition_id()), F.lit(self.n)))
        self.path = f"{shared_dir(self.spark).rstrip('/')}/{self.name}"
        dealt = dealt.repartition(buckets, "b")
        if code:
            function, schema = code
            dealt = dealt.groupBy("b").applyInArrow(lambda table: function(table), schema)
        with shuffles_end(self.spark):
            dealt.write.option("compression", "zstd").option("path", self.path).bucketBy(buckets, "b").saveAsTable(self.name)
        self.table = self.spark.table(self.name)

    def setting(self, name: str, otherwise: int) -> int:
        return int(self.spark.conf.get(name, str(otherwise)))

    def parts(self, keys: float) -> int:
        """How many parts ``keys`` keys are dealt to: as many as keep each at its size, and one a task of the shuffle at least."""
        wanted = math.ceil(keys / self.setting("spark.corvane.partKeys", PART_KEYS))
        return min(max(1, self.setting("spark.sql.shuffle.partitions", 200), wanted), 1 << SLOT_BITS)

    def each(self, function: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
        def one(table: pa.Table) -> pa.Table:
            found = function(table)
            release()
            return found

        return self.table.groupBy("b").applyInArrow(one, schema)

    def replied(self, replies: DataFrame, function: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        def one(table: pa.Table, answers: pa.Table) -> pa.Table:
            found = function(table, answers)
            release()
            return found

        return self.table.groupBy("b").cogroup(replies.groupBy("b")).applyInArrow(one, schema)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


def forward_rows(b: int, found: list[tuple[np.ndarray, list[np.ndarray], int, int, int]]) -> pa.Table:
    """What a batch sends. found: (sorted keys, values, bits, number of parts, first part) of each kind of key."""
    rows: dict = {"b": [], "part": [], "keys": [], "values": []}
    for keys, values, bits, parts, offset in found:
        for p, lo, hi in slices(keys, bits, parts):
            rows["b"].append(b)
            rows["part"].append(offset + p)
            rows["keys"].append(pack_sorted(keys[lo:hi]))
            rows["values"].append([pack_counts(v[lo:hi]) for v in values])
    return pa.table(rows, schema=_FORWARD)


def add_up(table: pa.Table, offset: int = 0) -> pa.Table:
    """One part's replies: the totals of each batch's keys; and a row with b = -1: distinct keys, and of each value the sum and the keys with any."""
    table = table.sort_by([("b", "ascending")])
    part, batches = table["part"][0].as_py() + offset, table["b"].to_pylist()
    keys = [unpack_sorted(x.as_buffer().to_pybytes()) for x in table["keys"]]
    sizes = [len(x) for x in keys]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    del keys
    values = table["values"].to_pylist()
    replies: list[list[bytes]] = [[] for _ in batches]
    stats = [len(distinct)]
    edges = np.concatenate([[0], np.cumsum(sizes)])
    any_value = np.zeros(len(distinct), bool)
    for k in range(len(values[0])):
        one = np.concatenate([unpack_counts(v[k]) for v in values])
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, place, one)
        stats += [int(total.sum()), int((total > 0).sum())]
        any_value |= total > 0
        each = total[place]
        for i in range(len(batches)):
            replies[i].append(pack_counts(each[edges[i] : edges[i + 1]]))
    stats.append(int(any_value.sum()))
    return pa.table({"b": [*batches, -1], "part": [part] * (len(batches) + 1), "totals": [*replies, None], "stats": [*[None] * len(batches), stats]}, schema=_REPLY)


def part_by_part(forward: DataFrame, parts: int, function: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``function`` on each of the parts 0 to ``parts`` - 1, each a task's own."""
    return forward.repartitionById(parts, "part").groupBy("part").applyInArrow(lambda table: function(table), schema)  # of one argument, as Spark looks at it


def totals(forward: DataFrame, parts: int, offset: int = 0) -> DataFrame:
    """Replies to all batches; their parts are numbered from ``offset``."""
    return part_by_part(forward, parts, partial(add_up, offset=offset), REPLY)


def read_totals(replies: pa.Table, offset: int, parts: int, k: int) -> np.ndarray:
    """Value ``k`` of a batch's keys of one kind, in the order of the keys."""
    rows = replies.sort_by([("part", "ascending")])
    got = [unpack_counts(v[k]) for p, v in zip(rows["part"].to_pylist(), rows["totals"].to_pylist(), strict=True) if offset <= p < offset + parts]
    return np.concatenate(got) if got else np.zeros(0, np.int64)

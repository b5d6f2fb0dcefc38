"""Exact de-duplication through a cuckoo-filter index over bucketed digests.

Texts are equal when they are identical after each run of white space is replaced by one space. A document is known by
the SHA-256 of that form; length in bytes and a second, independent hash stand beside it as its content record.

* Rows are condensed natively to one line per (digest, salt) before they are shuffled, so a group that holds a third of
  all rows arrives as at most ``SALTS`` lines.
* Lines are dealt to buckets by their digest. Each bucket has a cuckoo filter of 16-bit fingerprints and a store of its
  live keys. A line whose fingerprint is absent is new and is inserted without a look at the store; a hit is verified
  against the whole content record in the store, so a false positive never joins two texts.
* When an insertion finds no free place the filter is doubled and filled again from the stored keys.
* Deleting removes a verified key from the store and its fingerprint from the filter.

Buckets are sized by the number of lines, so a task holds a bounded number of keys. Everything is a function of its
input: a lost executor's buckets are computed again from shuffle or store.

Defined results: null counts as the empty text; empty texts are equal to each other; rows without doc_id come after all
others in their group; of repeated rows with one doc_id exactly one stays; an empty table gives no rows; other columns
are ignored by the index and carried by ``keep_first``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assay.llm.common import documents, partitions, register, stored, whole

SALTS = 16
LINES_PER_BUCKET = 50_000
NO_ID = 2**63 - 1
SMALL = 200_000  # keys of 40 bytes, 8 MB, that may be broadcast
KEY = ["digest", "n_bytes", "check"]
STORE = "bucket int, digest binary, n_bytes int, check bigint, first_id bigint, first_row bigint, n bigint, filter binary"


class CuckooFilter:
    """Partial-key cuckoo hashing: four places a bucket, 16-bit fingerprints, two candidate buckets a key."""

    SLOTS, KICKS = 4, 400

    def __init__(self, capacity: int = 64, table: np.ndarray | None = None):
        if table is None:
            buckets = 1 << max(1, math.ceil(math.log2(max(capacity, 2) / self.SLOTS / 0.85)))
            table = np.zeros(buckets * self.SLOTS, dtype=np.uint16)
        self.table = table.tolist()
        self.mask = len(self.table) // self.SLOTS - 1

    def places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[10:18], "little") & self.mask
        return mark, first, self.other(first, mark)

    def other(self, place: int, mark: int) -> int:
        return (place ^ (mark * 0x5BD1E995)) & self.mask

    def __contains__(self, digest: bytes) -> bool:
        mark, a, b = self.places(digest)
        s = self.SLOTS
        return mark in self.table[a * s:a * s + s] or mark in self.table[b * s:b * s + s]

    def _put(self, place: int, mark: int) -> bool:
        for i in range(place * self.SLOTS, (place + 1) * self.SLOTS):
            if not self.table[i]:
                self.table[i] = mark
                return True
        return False

    def insert(self, digest: bytes) -> bool:
        """False if no place was found. The filter has then lost a mark and must be rebuilt larger from its keys."""
        mark, a, b = self.places(digest)
        if self._put(a, mark) or self._put(b, mark):
            return True
        place = b
        for kick in range(self.KICKS):
            i = place * self.SLOTS + kick % self.SLOTS
            mark, self.table[i] = self.table[i], mark
            place = self.other(place, mark)
            if self._put(place, mark):
                return True
        return False

    def delete(self, digest: bytes) -> None:
        """Remove one mark of a key that is known to be in the filter."""
        mark, a, b = self.places(digest)
        for place in (a, b):
            for i in range(place * self.SLOTS, (place + 1) * self.SLOTS):
                if self.table[i] == mark:
                    self.table[i] = 0
                    return

    def grown(self, keys) -> "CuckooFilter":
        """A larger filter over the stored keys; doubles again until all fit."""
        capacity = 2 * len(self.table)
        while True:
            larger = CuckooFilter(table=np.zeros(capacity, dtype=np.uint16))
            if all(larger.insert(key[0]) for key in keys):
                return larger
            capacity *= 2

    def to_bytes(self) -> bytes:
        return np.asarray(self.table, dtype="<u2").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "CuckooFilter":
        return cls(table=np.frombuffer(data, dtype="<u2"))


class Bucket:
    """One bucket of the index: the filter and the live keys it stands for."""

    def __init__(self, rows: pd.DataFrame | None = None):
        self.keys: dict[tuple, list] = {}
        self.filter = CuckooFilter()
        if rows is None:
            return
        for digest, n_bytes, check, first_id, first_row, n, table in zip(
                rows.digest, rows.n_bytes, rows.check, rows.first_id, rows.first_row, rows.n, rows["filter"]):
            if table is not None:
                self.filter = CuckooFilter.from_bytes(table)
            else:
                self.keys[digest, n_bytes, check] = [(first_id, first_row), n]

    def insert(self, key: tuple, first: tuple, n: int) -> None:
        if key[0] in self.filter and (held := self.keys.get(key)) is not None:  # a hit counts only once the content agrees
            held[0] = min(held[0], first)
            held[1] += n
            return
        self.keys[key] = [first, n]
        if not self.filter.insert(key[0]):
            self.filter = self.filter.grown(self.keys)

    def delete(self, key: tuple) -> bool:
        if key[0] in self.filter and self.keys.pop(key, None) is not None:
            self.filter.delete(key[0])
            return True
        return False

    def frame(self, bucket: int) -> pd.DataFrame:
        rows = [(bucket, *key, *first, n, None) for key, (first, n) in self.keys.items()]
        rows.append((bucket, None, 0, 0, 0, 0, 0, self.filter.to_bytes()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in STORE.split(", ")])


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, digest, n_bytes, check) of every row, stored, so that row numbers stay as they are."""
    text = normalised(whole(F.col(text_col).cast("string")))
    return stored(docs.select(F.col(id_col).cast("long").alias("id"), text.alias("form")).select(
        F.monotonically_increasing_id().alias("row"), "id", F.unhex(F.sha2("form", 256)).alias("digest"),
        F.octet_length("form").alias("n_bytes"), F.xxhash64("form").alias("check")), "digests")


def lines(rows: DataFrame) -> DataFrame:
    """Rows condensed to one line per (digest, salt): the first row and the number of rows."""
    first = F.min(F.struct(F.coalesce("id", F.lit(NO_ID)).alias("id"), F.col("row").alias("row")))
    return rows.groupBy(*KEY, F.pmod("row", F.lit(SALTS)).alias("salt")).agg(first.alias("f"), F.count(F.lit(1)).alias("n")).select(
        *KEY, F.col("f.id").alias("first_id"), F.col("f.row").alias("first_row"), "n")


class CuckooIndex:
    """The index as a stored table: one row per live key and one row per bucket that holds its filter."""

    def __init__(self, table: DataFrame, buckets: int):
        self.table, self.buckets = table, buckets

    @classmethod
    def empty(cls, spark: SparkSession, expected: int) -> "CuckooIndex":
        return cls(spark.createDataFrame([], STORE), max(4 * partitions(spark), math.ceil(expected / LINES_PER_BUCKET)))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("digest"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _changed(self, batch: DataFrame, deleting: bool) -> "CuckooIndex":
        def work(key: tuple, new: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            bucket = Bucket(held)
            for digest, n_bytes, check, first_id, first_row, n in zip(
                    new.digest, new.n_bytes, new.check, new.first_id, new.first_row, new.n):
                if deleting:
                    bucket.delete((digest, n_bytes, check))
                else:
                    bucket.insert((digest, n_bytes, check), (first_id, first_row), n)
            return bucket.frame(int(key[0]))

        made = batch.withColumn("bucket", self._bucket()).groupBy("bucket").cogroup(self.table.groupBy("bucket")).applyInPandas(work, STORE)
        return CuckooIndex(stored(made, "cuckoo"), self.buckets)

    def insert(self, batch: DataFrame) -> "CuckooIndex":
        """The index with all lines of ``batch`` (as ``lines`` gives them) entered."""
        return self._changed(batch, False)

    def delete(self, keys: DataFrame) -> "CuckooIndex":
        """The index without the given keys (digest, n_bytes, check); keys it does not hold are passed over."""
        return self._changed(keys.select(*KEY, *[F.lit(0).cast("long").alias(c) for c in ("first_id", "first_row", "n")]), True)

    def live(self) -> DataFrame:
        return self.table.where("filter IS NULL").select(*KEY, "first_id", "first_row", "n")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256`` (and ``row``, its number in this run)."""
    rows = digests(docs, id_col, text_col)
    batch = stored(lines(rows), "lines")
    index = CuckooIndex.empty(docs.sparkSession, batch.count()).insert(batch)
    return rows.join(index.live(), KEY).select(
        F.col("id").alias("doc_id"), F.when(F.col("first_id") != NO_ID, F.col("first_id")).alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("first_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents without later copies, all columns as they were.

    Rows are told apart by doc_id and text; should one doc_id carry a text several times, one of the rows stays.
    """
    flags = exact_groups(docs).select(F.col("doc_id").alias("__id"), F.unhex("text_sha256").alias("__digest"), "kept")
    keys = stored(flags.groupBy("__id", "__digest").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "copies")
    gone = keys.where("NOT kept").select("__id", "__digest")
    digest = F.unhex(F.sha2(normalised(whole(F.col("text").cast("string"))), 256))
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (digest == F.col("__digest"))
    rest = docs.join(F.broadcast(gone) if gone.count() <= SMALL else gone, on, "left_anti")
    return rest if keys.where("kept AND n > 1").isEmpty() else rest.withColumn("__digest", digest).dropDuplicates(["doc_id", "__digest"]).drop("__digest")


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


@register("op10_exact_dedup", SQL)
def op10_exact_dedup(spark: SparkSession, root: str) -> DataFrame:
    return exact_groups(documents(spark, root))

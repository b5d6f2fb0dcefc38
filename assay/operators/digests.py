"""What changed between two versions of a table, found by digests of ranges of keys.

A version's rows fall into ``2^bits`` ranges by a hash of their key. The digest of a range is its number of rows and two sums of row hashes, so it
does not depend on the order of rows, adds up to the digests of wider ranges, and can be stored with the version. Two versions are compared
from the widest ranges down, ``STEP`` bits at a time; only ranges below one that differs are looked at, and only rows of ranges that differ at the
finest level are read and compared. Equal tables are known to be equal from one line each.

Rows are compared as they are, repeated rows and null keys included: a row that stands in both versions n and m times has changed n - m times. A key
of which one row went and one came was updated; else every row that went is a delete, every row that came an insert.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assay.operators.ordered import join_null_safe, sized
from assay.session import cut

BITS, STEP = 16, 4
SUMS = ["n", "s0", "s1"]


def _marked(names: list[str]) -> list[Column]:
    """Values as texts that tell null from every value."""
    return [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in names]


def range_of(keys: list[str], bits: int = BITS) -> Column:
    """The range (0 to 2^bits - 1) of a key."""
    return F.shiftrightunsigned(F.xxhash64(*_marked(keys)), 64 - bits).cast("int")


def digests(df: DataFrame, keys: list[str], cols: list[str], bits: int = BITS) -> DataFrame:
    """One line per range that has rows: ``range, n, s0, s1``."""
    every = _marked([*keys, *cols])
    rows = df.select(range_of(keys, bits).alias("range"), F.xxhash64(*every).alias("h0"), F.xxhash64(F.lit("second"), *every).alias("h1"))
    return rows.groupBy("range").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"h{i}").cast("decimal(38,0)")).alias(f"s{i}") for i in (0, 1)])


def differing(old: DataFrame, new: DataFrame, bits: int = BITS, step: int = STEP) -> DataFrame:
    """Ranges in which two versions differ, from their stored digests, level by level; ``range``."""
    lines = old.select("range", *SUMS).unionByName(new.select("range", *[(-F.col(c)).alias(c) for c in SUMS]))
    apart = cut(lines.groupBy("range").agg(*[F.sum(c).alias(c) for c in SUMS]))  # per range, what one version has beyond the other
    wanted = None
    for level in range(min(step, bits), bits + step, step):
        width = min(level, bits)
        at = F.shiftright("range", bits - width)
        seen = apart if wanted is None else apart.join(F.broadcast(wanted), F.shiftright("range", bits - before) == F.col("__at"), "left_semi")
        wanted = seen.groupBy(at.alias("__at")).agg(*[F.sum(c).alias(c) for c in SUMS]).where(" OR ".join(f"{c} <> 0" for c in SUMS)).select("__at")
        before = width
    return wanted.withColumnRenamed("__at", "range")


def row_changes(old: DataFrame, new: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Changed rows as ``keys, change, old, new, copies``: ``old`` and ``new`` are the columns ``cols`` as a struct of texts, null on the side that has none."""
    side = lambda df, n: df.select(*keys, F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols]).alias("row"), F.lit(n).cast("long").alias("step"))
    lines = side(old, -1).unionByName(side(new, 1)).groupBy(*keys, "row").agg(F.sum("step").alias("step")).where("step <> 0")
    gone, came = F.col("step") < 0, F.col("step") > 0
    per_key = lines.groupBy(*keys).agg(
        F.sum(F.when(gone, -F.col("step")).otherwise(0)).alias("n_gone"), F.sum(F.when(came, F.col("step")).otherwise(0)).alias("n_came"),
        F.max(F.when(gone, F.col("row"))).alias("old"), F.max(F.when(came, F.col("row"))).alias("new"))
    one = (F.col("n_gone") == 1) & (F.col("n_came") == 1)
    updates = per_key.where(one).select(*keys, F.lit("update").alias("change"), "old", "new", F.lit(1).cast("long").alias("copies"))
    others = join_null_safe(lines, per_key.where(~one).select(*keys, F.lit(True).alias("__other")), keys, "inner").select(
        *keys, F.when(gone, "delete").otherwise("insert").alias("change"), F.when(gone, F.col("row")).alias("old"), F.when(came, F.col("row")).alias("new"),
        F.abs("step").alias("copies"))
    return updates.unionByName(others)


def field_changes(changes: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """One line per changed field of each changed row: ``keys, change, field, old_value, new_value``. A row that went or came several times has its lines as often."""
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col("old")[c].alias("old_value"), F.col("new")[c].alias("new_value")) for c in cols])
    each = changes.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select(*keys, "change", F.explode(fields).alias("f")).select(*keys, "change", "f.*").where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def changed_rows(old: DataFrame, new: DataFrame, keys: list[str], cols: list[str], old_digests: DataFrame | None = None, new_digests: DataFrame | None = None,
                 bits: int = BITS) -> DataFrame:
    """``row_changes`` of two versions, from the rows of differing ranges only; digests that are stored with a version are not computed again."""
    old_digests = digests(old, keys, cols, bits) if old_digests is None else old_digests
    new_digests = digests(new, keys, cols, bits) if new_digests is None else new_digests
    ranges = sized(differing(old_digests, new_digests, bits))
    inside = lambda df: df.join(ranges, range_of(keys, bits) == F.col("range"), "left_semi")
    return row_changes(inside(old), inside(new), keys, cols)

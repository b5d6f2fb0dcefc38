"""Which columns hold values of which others: inclusion dependencies between all columns of all tables, without being told where to look.

Every value is shuffled once, in the type of its kind. Values of one kind meet under one key with the set of columns that hold them; the sets are counted, and
from these few lines follow the distinct values of every column and of every pair. Before that, a sample of the values by hash (all columns take the
same values, so a value of the sample that a column lacks is missing for certain) and the rows of each column rule out pairs that cannot
reach the wanted share; columns in no pair left are never shuffled whole.

Columns are compared within a kind: whole numbers, other numbers, texts, dates and times, truth values. Columns of nested types hold no keys and
are left out. Values longer than ``LONG`` bytes meet by their SHA-256.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from assay.session import cut

LONG = 64
BITS = 62  # columns whose bits lie in one whole number
SAMPLE = 2_000_000  # values of all columns together that the sample is meant to hold
PAIR = "child string, child_column string, parent string, parent_column string"

KINDS = {"i": (T.IntegralType,), "n": (T.FractionalType,), "s": (T.StringType, T.CharType, T.VarcharType),
         "t": (T.DateType, T.TimestampType, T.TimestampNTZType), "b": (T.BooleanType,)}


def kind_of(data_type: T.DataType) -> str | None:
    return next((k for k, types in KINDS.items() if isinstance(data_type, types)), None)


def value_of(name: str, kind: str) -> Column:
    """The value in the one type of its kind; equal values of one kind are equal in it. Long texts are their SHA-256."""
    c = F.col(f"`{name}`")
    if kind == "i":
        return c.cast("long")
    if kind == "n":
        return c.cast("double") + F.lit(0.0)  # -0.0 is 0.0
    if kind == "t":
        return c.cast("timestamp").cast("timestamp_ntz")
    text = c.cast("string")
    return F.when(F.octet_length(text) > LONG, F.sha2(text.cast("binary"), 256)).otherwise(text) if kind == "s" else text


class Columns:
    """All comparable columns of the tables, numbered in the order of the tables and their schemas."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = tables
        self.names = [(t, f.name, k) for t, df in tables.items() for f in df.schema.fields if (k := kind_of(f.dataType))]

    def values(self, wanted: set[int], every: int = 1) -> list[DataFrame]:
        """(key, col) of the wanted columns, a table for each kind; of one in ``every`` values by hash."""
        out = []
        for kind in KINDS:
            parts = []
            for table, df in self.tables.items():
                cells = [F.struct(F.lit(i).alias("col"), value_of(c, k).alias("key")) for i, (t, c, k) in enumerate(self.names) if t == table and k == kind and i in wanted]
                if cells:
                    parts.append(df.select(F.explode(F.array(*cells)).alias("x")).select("x.key", "x.col").where("key IS NOT NULL"))
            if parts:
                rows = reduce(DataFrame.unionByName, parts)
                out.append(rows if every == 1 else rows.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0))
        return out

    def filled(self) -> dict[int, tuple[int, int]]:
        """Values that are not null, and rows, of every column: one pass over each table, one line each."""
        out = {}
        for table, df in self.tables.items():
            mine = [(i, c) for i, (t, c, _) in enumerate(self.names) if t == table]
            line = df.agg(F.count(F.lit(1)), *[F.count(f"`{c}`") for _, c in mine]).first()
            out |= {i: (n, line[0]) for (i, _), n in zip(mine, line[1:])}
        return out


def shared(columns: Columns, wanted: set[int], every: int = 1) -> tuple[dict[int, int], dict[tuple[int, int], int]]:
    """Distinct values of every column and of every two. What is collected has one line a pair of columns.

    The columns that hold a value are bits of one or more whole numbers: an aggregate of fixed width, which is condensed before the shuffle.
    """
    order = sorted(wanted)
    words = [order[i:i + BITS] for i in range(0, len(order), BITS)]
    names = [f"w{i}" for i in range(len(words))]
    bit = [F.coalesce(*[F.when(F.col("col") == c, F.lit(1 << i)) for i, c in enumerate(word)], F.lit(0)).cast("long").alias(n) for n, word in zip(names, words)]
    sets = []
    for values in columns.values(wanted, every):
        held = values.select("key", *bit).groupBy("key").agg(*[F.bit_or(n).alias(n) for n in names])
        sets.append(held.groupBy(*names).agg(F.count(F.lit(1)).alias("n")))
    counted = cut(reduce(DataFrame.unionByName, sets))
    cols = F.array_compact(F.array(*[F.when(F.col(n).bitwiseAND(F.lit(1 << i)) != 0, F.lit(c)) for n, word in zip(names, words) for i, c in enumerate(word)]))
    counted = counted.select(cols.alias("cols"), "n")
    pairs = counted.select(F.explode("cols").alias("a"), "cols", "n").select("a", F.explode("cols").alias("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("n"))
    found = {(r.a, r.b): r.n for r in pairs.collect()}
    return {a: n for (a, b), n in found.items() if a == b}, found


def inclusions(tables: dict[str, DataFrame], t: float = 1.0, sample: int = SAMPLE) -> DataFrame:
    """Every pair of columns of which the parent holds at least the share ``t`` of the child's distinct values.

    One line a pair: ``child, child_column, parent, parent_column, child_values, matched, parent_values, parent_unique`` (no value of the parent
    repeats and none is null). A column without values is in no pair. Nothing is estimated: the sample only rules out.
    """
    if not 0 < t <= 1:
        raise ValueError("the share must be above 0 and at most 1")
    columns = Columns(tables)
    spark = next(iter(tables.values())).sparkSession
    filled = columns.filled()
    alive = {i for i, (n, _) in filled.items() if n}
    every = max(1, sum(filled[i][0] for i in alive) // sample)
    pairs = {(a, b) for a in alive for b in alive if a != b and columns.names[a][2] == columns.names[b][2]}
    if every > 1 and pairs:
        size, both = shared(columns, alive, every)
        # What the sample lacks is lacking; a column has no more distinct values than filled rows.
        pairs = {(a, b) for a, b in pairs if size.get(a, 0) - both.get((a, b), 0) <= (1 - t) * filled[a][0]}
    left = {i for pair in pairs for i in pair}
    size, both = shared(columns, left) if left else ({}, {})
    name = lambda i: columns.names[i][:2]
    lines = [(*name(a), *name(b), size[a], both.get((a, b), 0), size[b], size[b] == filled[b][0] == filled[b][1])
             for a, b in sorted(pairs) if both.get((a, b), 0) >= t * size[a]]
    return spark.createDataFrame(lines, f"{PAIR}, child_values long, matched long, parent_values long, parent_unique boolean")


def stem(name: Column) -> Column:
    """A column's name without the one or two letters by which tables mark their columns (``o_custkey``: custkey)."""
    return F.regexp_replace(F.lower(name), "^[a-z]{1,2}_", "")


def inferred_keys(found: DataFrame, same_name: bool = True) -> DataFrame:
    """Key relationships among inclusions: the parent's column is a key and, unless told otherwise, has the child's name.

    Small whole numbers lie in many keys by chance; the name tells these apart. A child whose values are the whole parent both ways (two keys of one
    entity) is listed once, from the larger table's side, or the first by name.
    """
    edges = found.where("parent_unique")
    if same_name:
        edges = edges.where(stem(F.col("child_column")) == stem(F.col("parent_column")))
    back = edges.select(*[F.col(a).alias(f"__{b}") for a, b in (("child", "parent"), ("child_column", "parent_column"), ("parent", "child"), ("parent_column", "child_column"))])
    both = edges.join(back, [F.col(c) == F.col(f"__{c}") for c in ("child", "child_column", "parent", "parent_column")], "left")
    mutual = F.col("__child").isNotNull() & ((F.col("child_values") > F.col("parent_values")) | ((F.col("child_values") == F.col("parent_values")) & (
        F.struct("child", "child_column") < F.struct("parent", "parent_column"))))
    return both.where(~mutual).select(*found.columns)

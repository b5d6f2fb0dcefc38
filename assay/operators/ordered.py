"""Order-dependent operators that stay balanced when one key holds much of the table.

``Window.partitionBy(key)`` puts all rows of a key into one task. The functions here first count the rows per key. If no key
is too large for one task, the plain window runs. Otherwise the rows of the large keys are range-partitioned by ``(keys, order)``, with
borders that Spark measures on a sample, and stored with their partition number as span: consecutive stretches of about
``HOT_ROWS`` rows, whatever the type and spread of the order columns. Work is done inside ``(key, span)``, and the few
values that cross a span border are carried through a summary with one row per span. Results equal those of the plain window.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from assay.session import cut

HOT_ROWS = 1_000_000          # a group up to this size is ordinary work for one task
BROADCAST_BYTES = 16_000_000  # key lists and group figures up to this measured size are broadcast
SPAN = "__span"
SCOUTS = 1_000                # one row in so many tells whether groups are large


def join_null_safe(left: DataFrame, right: DataFrame, names: list[str], how: str = "left") -> DataFrame:
    """Join in which null keys meet; the right copy of the key columns is dropped."""
    other = right.select(*[F.col(n).alias(f"__r_{n}") if n in names else F.col(n) for n in right.columns])
    on = reduce(lambda a, b: a & b, [left[n].eqNullSafe(other[f"__r_{n}"]) for n in names])
    return left.join(other, on, how).drop(*[f"__r_{n}" for n in names])


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: texts by their length, nested values by their JSON form, others eight."""
    def one(f: T.StructField) -> Column:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return F.octet_length(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.octet_length(F.to_json(F.struct(f.name)))
        return F.lit(0)
    return sum((F.coalesce(one(f), F.lit(0)) + 8 for f in df.schema.fields), F.lit(0)).cast("long")


def sized(small: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Store a condensed table once and measure it: a small one is marked for broadcast, a large one joins by shuffle.

    Without this, Spark judges the table by the size of what it was computed from, and shuffles the
    large side of the join for the sake of a handful of rows.
    """
    stored = cut(small)
    limit = BROADCAST_BYTES if max_bytes is None else max_bytes
    return F.broadcast(stored) if (stored.agg(F.sum(row_bytes(stored))).first()[0] or 0) <= limit else stored


@dataclass(frozen=True)
class Hot:
    """The keys that are too large for one task, how many rows they have together, and how many a span is to hold."""
    keys: DataFrame
    rows: int
    unit: int


def hot_keys(df: DataFrame, keys: list[str], order: list[str], hot_rows: int | None = None) -> Hot | None:
    """Find the keys with too many rows for one task, in one condensing pass.

    None when there is no such key, which lets the callers use the plain window. ``hot_rows`` overrides the
    limit in tests.
    """
    unit = HOT_ROWS if hot_rows is None else hot_rows
    found = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > unit))
    total = found.agg(F.sum("__n")).first()[0]
    return Hot(sized(found.drop("__n")), total, unit) if total else None


def scouts(df: DataFrame) -> DataFrame:
    """The rows that ``crowded`` looks at."""
    return df.sample(1 / SCOUTS, seed=7)


def crowded(scouted: DataFrame, keys: list[str], hot_rows: int | None = None) -> bool:
    """Whether a key seems to hold more rows than one task should take, judged by ``scouts``.

    It may choose between two plans that give the same rows; no result is taken from it.
    """
    unit = HOT_ROWS if hot_rows is None else hot_rows
    largest = scouted.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).agg(F.max("__n")).first()[0]
    return SCOUTS * (largest or 0) > unit


def spanned(df: DataFrame, keys: list[str], order: list[str], hot: Hot) -> DataFrame:
    """Add the span number: 0 for rows of ordinary keys; it grows along the order of the large ones, whose rows are stored.

    The range partitioner compares all order columns, nulls first, so only rows that are equal in all of
    them must share a span.
    """
    marked = hot.keys.withColumn("__hot", F.lit(True))
    rows = join_null_safe(df, marked, keys, "inner").drop("__hot")
    ranged = rows.repartitionByRange(max(1, math.ceil(hot.rows / hot.unit)), *[F.col(c).asc() for c in dict.fromkeys([*keys, *order])])
    cold = join_null_safe(df, marked, keys, "left").where("__hot IS NULL").drop("__hot").withColumn(SPAN, F.lit(0))
    return cold.unionByName(cut(ranged.withColumn(SPAN, F.spark_partition_id() + 1)))


def _ordering(order: list[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in order]


AUTO = object()


def neighbour(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, tuple[str, int]],
    following: bool = False,
    hot=AUTO,
    hot_rows: int | None = None,
) -> DataFrame:
    """Value ``n`` rows back (or ahead) in the key's order, as ``{new column: (source column, n)}``.

    ``order`` must be a total order within the key. Spans of a hot key receive the last ``n`` rows of
    the spans before them as extra rows, which are removed after the window has run. ``hot`` takes a
    list already found by ``hot_keys``.
    """
    hot = hot_keys(df, keys, order, hot_rows) if hot is AUTO else hot
    ordering = _ordering(order, following)
    if hot is None:
        window = W.partitionBy(*keys).orderBy(*ordering)
        return df.withColumns({name: F.lag(c, n).over(window) for name, (c, n) in values.items()})

    reach = max(n for _, n in values.values())
    group = [*keys, SPAN]
    source = sorted({c for c, _ in values.values()})
    carried = sorted({*keys, *order, *source})
    all_rows = spanned(df, keys, order, hot)
    from_end = W.partitionBy(*group).orderBy(*_ordering(order, not following))
    tail = cut(
        all_rows.where(F.col(SPAN) > 0).select(*carried, SPAN)
        .withColumn("__rank", F.row_number().over(from_end)).where(F.col("__rank") <= reach))
    along = W.partitionBy(*keys).orderBy(F.col(SPAN).desc() if following else F.col(SPAN).asc())
    sizes = tail.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    targets = sizes.select(
        *group,
        F.array(*[
            F.struct(
                F.lead(SPAN, step).over(along).alias("span"),
                (F.lit(0).cast("long") if step == 1 else F.coalesce(
                    F.sum("__n").over(along.rowsBetween(1, step - 1)), F.lit(0).cast("long")
                )).alias("between"),
            )
            for step in range(1, reach + 1)
        ]).alias("__next"),
    )
    halo = (
        join_null_safe(tail, targets, group, "inner")
        .withColumn("__to", F.explode("__next"))
        .where(F.col("__to.span").isNotNull() & (F.col("__rank") - 1 + F.col("__to.between") < reach))
        .withColumn(SPAN, F.col("__to.span"))
        .select(*carried, SPAN, F.lit(True).alias("__halo"))
    )
    both = all_rows.withColumn("__halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)
    window = W.partitionBy(*group).orderBy(*ordering)
    out = both.withColumns({name: F.lag(c, n).over(window) for name, (c, n) in values.items()})
    return out.where(~F.col("__halo")).drop("__halo", SPAN)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, Column],
    how: str = "sum",
    inclusive: bool = True,
    hot=AUTO,
    hot_rows: int | None = None,
) -> DataFrame:
    """Running sums (or maxima) per key in the given total order, with or without the row itself."""
    hot = hot_keys(df, keys, order, hot_rows) if hot is AUTO else hot
    fold = {"sum": F.sum, "max": F.max}[how]
    upto = lambda group: W.partitionBy(*group).orderBy(*_ordering(order, False)).rowsBetween(
        W.unboundedPreceding, 0 if inclusive else -1)
    if hot is None:
        return df.withColumns({n: fold(e).over(upto(keys)) for n, e in values.items()})
    group = [*keys, SPAN]
    all_rows = spanned(df, keys, order, hot)
    along = W.partitionBy(*keys).orderBy(SPAN).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        all_rows.where(F.col(SPAN) > 0)
        .groupBy(*group).agg(*[fold(e).alias(n) for n, e in values.items()])
        .select(*group, *[fold(n).over(along).alias(f"__o_{n}") for n in values])
    )
    local = all_rows.withColumns({n: fold(e).over(upto(group)) for n, e in values.items()})
    both = (lambda n: F.greatest(n, f"__o_{n}")) if how == "max" else (
        lambda n: F.when(F.col(f"__o_{n}").isNull(), F.col(n)).otherwise(F.coalesce(F.col(n) + F.col(f"__o_{n}"), F.col(f"__o_{n}"))))
    return join_null_safe(local, offsets, group).withColumns({n: both(n) for n in values}).drop(
        SPAN, *[f"__o_{n}" for n in values])


def position(df: DataFrame, keys: list[str], order: list[str], out: str = "position", hot=AUTO,
             hot_rows: int | None = None) -> DataFrame:
    """1, 2, 3, … per key in the given total order."""
    return running(df, keys, order, {out: F.lit(1).cast("long")}, hot=hot, hot_rows=hot_rows)


def rolling(
    df: DataFrame,
    keys: list[str],
    ts: str,
    measures: dict[str, Column],
    spans: dict[str, int],
    tick: str = "day",
    hot_rows: int | None = None,
) -> DataFrame:
    """Trailing sums per key at day or second grain: one row per ``(key, tick)`` that occurs.

    ``measures`` are summed; ``spans`` maps a suffix to a number of ticks, the current one included, so
    ``{"7d": 7}`` at day grain covers today and the six days before. Rows are first summed per tick with
    map-side aggregation. A trailing sum is the difference of two running sums, at the tick and just before
    the window; the running sums split large keys, so no group grows with the window. A window without any
    value sums to null. Measures should be whole numbers or decimals, whose sums are exact.
    """
    at = F.unix_date(F.col(ts).cast("date")).cast("long") if tick == "day" else F.unix_seconds(F.col(ts).cast("timestamp"))
    ticks = df.groupBy(*keys, at.alias("tick")).agg(*[F.sum(e).alias(n) for n, e in measures.items()])
    if hot_keys(ticks, keys, ["tick"], hot_rows) is None:
        over = lambda length: W.partitionBy(*keys).orderBy("tick").rangeBetween(1 - length, 0)
        return ticks.select(*keys, "tick", *measures, *[F.sum(n).over(over(length)).alias(f"{n}_{label}") for n in measures for label, length in spans.items()])
    probes = [F.struct(F.col("tick").alias("at"), F.lit(0).alias("kind"))] + [
        F.struct((F.col("tick") - length).alias("at"), F.lit(i).alias("kind")) for i, length in enumerate(spans.values(), 1)]
    lines = ticks.select("*", F.explode(F.array(*probes)).alias("__e")).select("*", F.col("__e.at").alias("__at"), F.col("__e.kind").alias("__kind")).drop("__e")
    # a line of a tick adds its values; a line just before a window adds nothing and reads the sum there
    adds = F.col("__kind") == 0
    sums = {f"__s_{n}": F.coalesce(F.when(adds, F.col(n)), F.lit(0)) for n in measures}
    filled = {f"__c_{n}": F.when(adds & F.col(n).isNotNull(), 1).otherwise(0).cast("long") for n in measures}
    summed = running(lines.withColumn("__probe", (~adds).cast("int")), keys, ["__at", "__probe", "tick", "__kind"], sums | filled, hot_rows=hot_rows)
    here = lambda c, kind: F.max(F.when(F.col("__kind") == kind, F.col(c)))
    total = lambda n, i: F.when(here(f"__c_{n}", 0) > here(f"__c_{n}", i), here(f"__s_{n}", 0) - here(f"__s_{n}", i))
    return summed.groupBy(*keys, "tick").agg(
        *[F.max(n).alias(n) for n in measures], *[total(n, i).alias(f"{n}_{label}") for n in measures for i, label in enumerate(spans, 1)])


def prefix_sums(df: DataFrame, index: str, value: str, out: str, block: int = 4096) -> DataFrame:
    """Sum of ``value`` over all smaller ``index`` numbers; one line per index, which may be many.

    Blocks of indexes are summed inside tasks; only one line per block meets in a single task. The lines
    are stored first, because they are read twice.
    """
    blocked = cut(df).withColumn("__block", F.floor(F.col(index) / block))
    along = W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy("__block").orderBy(index).rowsBetween(W.unboundedPreceding, -1)
    base = blocked.groupBy("__block").agg(F.sum(value).alias("__v")).select(
        "__block", F.coalesce(F.sum("__v").over(along), F.lit(0)).alias("__base"))
    return blocked.join(base, "__block").withColumn(
        out, F.col("__base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("__block", "__base")


def first_rows(df: DataFrame, keys: list[str], order: list[Column | str], k: int = 1,
               rank: str | None = None) -> DataFrame:
    """First ``k`` rows per key. Spark prunes each task's groups to ``k`` rows before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    name = rank or "__rn"
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], accuracy: int = 100_000) -> DataFrame:
    """Exact nearest-rank quantiles (smallest value with at least ``ceil(p * n)`` rows at or below it).

    One pass brackets each quantile with a mergeable sketch of bounded size. The second counts every value that
    lies in a bracket, about ``6 / accuracy`` of the table per quantile, and all other rows as a few lines by the brackets
    they lie below. What follows reads condensed lines only; their running count is split like any large group.
    """
    rows = df.select(F.col(value).alias("v")).where(F.col("v").isNotNull())
    margin = 3.0 / accuracy
    sketch = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.percentile_approx("v", max(0.0, p - margin), accuracy).alias(f"lo_{k}") for k, p in probs.items()],
        *[F.percentile_approx("v", min(1.0, p + margin), accuracy).alias(f"hi_{k}") for k, p in probs.items()],
    )
    packed = sketch.select(F.struct(*sketch.columns).alias("s")).scalar()
    inside = reduce(lambda a, b: a | b, [F.col("v").between(F.col(f"s.lo_{k}"), F.col(f"s.hi_{k}")) for k in probs])
    below = reduce(lambda a, b: a + b, [F.when(F.col("v") < F.col(f"s.lo_{k}"), 1 << i).otherwise(0) for i, k in enumerate(probs)])
    lines = cut(rows.withColumn("s", packed).groupBy(F.when(inside, F.col("v")).alias("v"), below.alias("below"), "s").agg(F.count(F.lit(1)).alias("c")))
    places = F.array(*[
        F.struct(F.lit(k).alias("name"), F.greatest(F.ceil(F.lit(p) * F.col("s.n")), F.lit(1).cast("long")).alias("want"),
                 (F.col("below").bitwiseAND(F.lit(1 << i)) > 0).alias("below"), F.col("v").between(F.col(f"s.lo_{k}"), F.col(f"s.hi_{k}")).alias("inside"))
        for i, (k, p) in enumerate(probs.items())])
    counted = lines.select("v", "c", F.explode(places).alias("q")).where("q.below OR q.inside").groupBy(
        F.col("q.name").alias("name"), F.when(~F.col("q.below"), F.col("v")).alias("v")).agg(F.sum("c").alias("c"), F.max("q.want").alias("want"))
    return (
        running(cut(counted), ["name"], ["v"], {"upto": F.col("c")})
        .where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("c") < F.col("want")))
        .select("name", F.col("v").alias("value"))
    )

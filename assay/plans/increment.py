"""Silver, Gold and their totals carried forward by what is new in Bronze.

Silver and Gold lie in partitions that are a function of the key. A run takes the Bronze rows above the watermark, finds the partitions they touch,
and rewrites those only: old rows and new ones meet, the last version of each key stands. The row rules part the result into Gold and
quarantine. Totals per group are not summed anew: what the touched partitions gave before is taken back and what they give now is
added, in those buckets of groups whose sums change.

Every run writes new folders beside the old (``version=N``) and then, last, one small file: its commit, with the watermark and the versions of
what it wrote. A reader sees what commits name. A run that broke off has no commit; it changes nothing that is read, and the
next run takes the same number and overwrites what it left.

A run that touches more than FOLDERS partitions writes neighbouring ones into one folder, each row with its partition and version, so that files grow
with the rows and not with the number of partitions. Its commit still names every partition: one that a later run rewrites is left out when
its old folder is read.

The row rules look at single rows, so Gold and quarantine are filtered from Silver's files without a shuffle, each task into the folders that it reads.

Defined results: a row older than the one that stands is ignored whenever it arrives; of rows that are equal in the order, the one with the
larger hash of all columns stands; a deleted key stays as a marker in Silver, so that older rows do not bring it back, and is in neither Gold nor
quarantine nor totals; a null in a key is a value like any other; a run without new rows commits nothing. One run at a time.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from assay.operators import rules as R
from assay.operators.clean import transform_chain
from assay.operators.ordered import first_rows
from assay.session import cut
from assay.sources.layers import part_path

COMMIT = "layer string, part string, version long, rows long, watermark string, folder string"
LANDING = ("_load_date", "_load_ts", "_source", "_batch_id")
BUCKETS = 32  # of the totals
FOLDERS = 128  # that a run writes in a layer


@dataclass(frozen=True)
class Target:
    """How a table is carried forward.

    ``part`` must be a function of the keys. ``order`` names columns by which the last version of a key is the highest. ``measures`` are summed per
    ``groups``; they must be whole numbers or decimals, whose sums are exact, and count a null as nothing.
    """
    name: str
    keys: list[str]
    order: list[str]
    part: Column
    rules: list[R.Row] = field(default_factory=list)
    steps: list = field(default_factory=list)
    deleted: Column | None = None
    groups: list[str] = field(default_factory=list)
    measures: dict[str, Column] = field(default_factory=dict)


class Store:
    """The versions of one table's layers under a root folder."""

    def __init__(self, spark: SparkSession, root: str, target: Target):
        self.spark, self.root, self.target = spark, root, target
        self.commits = f"{root}/commits/{target.name}"
        try:
            found = spark.read.schema(COMMIT).parquet(f"{self.commits}/*/*.parquet").collect()  # a line per partition that a run wrote
        except AnalysisException as absent:
            if absent.getCondition() != "PATH_NOT_FOUND":
                raise
            found = []
        self.version = max((r.version for r in found), default=0)
        self.watermark = next((r.watermark for r in found if r.version == self.version and r.layer == "run"), None)
        self.live: dict[tuple[str, str], tuple[int, int, str]] = {}
        self.held: Counter = Counter()  # partitions with rows in a folder, as it was written
        for r in sorted(found, key=lambda r: r.version):
            if r.layer != "run":
                folder = r.part if r.folder is None else r.folder
                self.live[(r.layer, r.part)] = (r.version, r.rows, folder)
                self.held[(r.layer, r.version, folder)] += r.rows > 0

    def folder(self, layer: str, version: int) -> str:
        return part_path(f"{self.root}/{layer}/{self.target.name}", version=str(version))

    def read(self, layer: str, schema, parts: list[str] | None = None) -> DataFrame:
        """Rows of a layer as the commits have it, of the given partitions or of all; only their folders are opened."""
        asked = None if parts is None else set(parts)
        wanted: dict[tuple[int, str], list[str]] = {}
        for (name, part), (version, rows, folder) in sorted(self.live.items()):
            if name == layer and rows and (asked is None or part in asked):
                wanted.setdefault((version, folder), []).append(part)
        whole = {at for at, found in wanted.items() if len(found) == self.held[(layer, *at)]}
        opened = lambda kinds, some: self.spark.read.schema(kinds).parquet(*[part_path(self.folder(layer, v), part=f) for v, f in sorted(some)])
        out = opened(schema, whole) if whole else self.spark.createDataFrame([], schema)
        mixed = wanted.keys() - whole
        if not mixed:
            return out
        standing = self.spark.createDataFrame([(v, p) for v, f in mixed for p in wanted[(v, f)]], "_version bigint, _part string")
        wide = T.StructType([*out.schema.fields, *standing.schema.fields])
        left = opened(wide, mixed).join(F.broadcast(standing), ["_version", "_part"], "left_semi").select(*out.columns)
        return out.unionByName(left) if whole else left

    def placed(self, df: DataFrame, version: int, touched: list[str]) -> DataFrame:
        """The rows with the name of their folder as ``part``; where partitions share folders, also with their partition and version."""
        if len(touched) <= FOLDERS:
            return df
        lies = self.spark.createDataFrame(list(_folders(touched).items()), "_part string, part string")
        return df.withColumnRenamed("part", "_part").join(F.broadcast(lies), "_part").withColumn("_version", F.lit(version).cast("long"))

    def write(self, df: DataFrame, layer: str, version: int, touched: list[str]) -> list[tuple]:
        """Write placed rows of a layer under a new version, as they are dealt out; gives the commit's lines."""
        path, folders = self.folder(layer, version), _folders(touched)
        df.write.mode("overwrite").partitionBy("part").parquet(path)
        by = "_part" if len(touched) > FOLDERS else "part"
        counts = {p: n for p, n in self.written(df, layer, version).groupBy(by).agg(F.count(F.lit(1))).collect()}
        return [(layer, p, version, counts.get(p, 0), None, folders[p]) for p in touched]

    def written(self, df: DataFrame, layer: str, version: int) -> DataFrame:
        """What was written from these placed rows, whether committed or not."""
        return self.spark.read.schema(df.schema).parquet(self.folder(layer, version))


def _folders(parts: list[str]) -> dict[str, str]:
    """The folder of each partition: its own, or, of many, the one named by the first of its neighbours. Shorter names come first, as numbers do."""
    ordered = sorted(parts, key=lambda p: (len(p), p))
    size = -(-len(ordered) // FOLDERS)
    return {p: ordered[i - i % size] for i, p in enumerate(ordered)}


def _dealt(placed: DataFrame) -> DataFrame:
    """The rows of a folder in one task, or, of a large one, split over tasks."""
    return placed.hint("rebalance", "part")


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "part")


def _touched(df: DataFrame) -> list[str]:
    """Partitions of these rows; their number is bounded by the layout."""
    return sorted(r.part for r in df.select("part").distinct().collect())


def _sums(target: Target, df: DataFrame, sign: int) -> DataFrame:
    signed = lambda m: -m if sign < 0 else m  # noqa: E731  a product would widen decimals beyond what fits a long
    return df.select(*target.groups, F.lit(sign).cast("long").alias("rows"), *[signed(F.coalesce(m, F.lit(0))).alias(n) for n, m in target.measures.items()])


def _totals(target: Target, df: DataFrame) -> DataFrame:
    names = ["rows", *target.measures]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.groupBy(*target.groups).agg(*[F.sum(n).cast(kinds[n]).alias(n) for n in names])


def _wide(df: DataFrame, target: Target) -> DataFrame:
    """Measures in the widest form, so that sums of sums keep one type."""
    for n in target.measures:
        kind = df.schema[n].dataType
        df = df.withColumn(n, F.col(n).cast(f"decimal(38,{kind.scale})" if kind.typeName() == "decimal" else "long"))
    return df


def advance(spark: SparkSession, root: str, target: Target, bronze: DataFrame, at: str = "_load_ts") -> dict:
    """Carry the table forward by the Bronze rows whose ``at`` lies above the watermark.

    Gives ``version, watermark, new_rows`` and the partitions rewritten (``touched``, and ``buckets`` of the totals).
    """
    store = Store(spark, root, target)
    kind = bronze.schema[at].dataType
    fresh = bronze if store.watermark is None else bronze.where(F.col(at) > F.lit(store.watermark).cast(kind))
    rows = transform_chain(fresh.drop(*[c for c in LANDING if c != at and c in fresh.columns]), target.steps)
    part = F.coalesce(target.part.cast("string"), F.lit("none"))
    fresh = cut(rows.withColumn("part", part))
    seen = cut(fresh.groupBy("part").agg(F.max(at).alias("at"), F.count(F.lit(1)).alias("n")))  # a line per partition
    line = seen.agg(F.max("at").cast("string"), F.sum("n")).first()
    if not line[1]:
        return {"version": store.version, "watermark": store.watermark, "new_rows": 0, "touched": [], "buckets": []}
    version, touched = store.version + 1, _touched(seen)
    fresh = fresh.drop(at) if at in LANDING else fresh

    shape = _columns(fresh)
    old = store.read("silver", shape, touched).withColumn("part", part)
    latest = [F.col(c).desc_nulls_last() for c in target.order] + [F.xxhash64(*[c for c in fresh.columns if c != "part"]).desc()]
    stands = store.placed(first_rows(old.unionByName(fresh), target.keys, latest), version, touched)
    lines = store.write(_dealt(stands), "silver", version, touched)

    silver = store.written(stands, "silver", version)
    alive = silver if target.deleted is None else silver.where(~F.coalesce(target.deleted, F.lit(False)))
    judged = R.judge(alive, target.rules) if target.rules else alive.withColumn("failed_rules", F.array().cast("array<string>"))
    lines += store.write(judged.where(F.size("failed_rules") == 0).drop("failed_rules"), "gold", version, touched)
    lines += store.write(judged.where(F.size("failed_rules") > 0), "quarantine", version, touched)

    buckets: list[str] = []
    if target.groups:
        gold = spark.read.schema(shape).parquet(store.folder("gold", version))
        change = _wide(_sums(target, gold, 1).unionByName(_sums(target, store.read("gold", shape, touched), -1)), target)
        bucket = F.pmod(F.xxhash64(*target.groups), F.lit(BUCKETS)).cast("string")
        moved = " OR ".join(f"`{n}` <> 0" for n in ["rows", *target.measures])
        delta = cut(_totals(target, change).where(moved).withColumn("part", bucket))
        buckets = _touched(delta)
        before = store.read("totals", _columns(delta), buckets)
        after = _totals(target, before.unionByName(delta.drop("part"))).where("rows <> 0").withColumn("part", bucket)
        if buckets:
            lines += store.write(_dealt(store.placed(after, version, buckets)), "totals", version, buckets)
    commit(spark, store, version, lines, line[0])
    return {"version": version, "watermark": line[0], "new_rows": line[1], "touched": touched, "buckets": buckets}


def commit(spark: SparkSession, store: Store, version: int, lines: list[tuple], watermark: str) -> None:
    """Make a version readable: one file, put in place by one rename."""
    done = spark.createDataFrame([*lines, ("run", None, version, None, watermark, None)], COMMIT)
    done.coalesce(1).write.mode("overwrite").parquet(part_path(store.commits, version=str(version)))


def read(spark: SparkSession, root: str, target: Target, layer: str, schema: str) -> DataFrame:
    """A layer (``silver``, ``gold``, ``quarantine``, ``totals``) as of the last commit."""
    return Store(spark, root, target).read(layer, schema)

"""Merkle manifest of a dataset: one digest for a table, a proof for every row, by nested-interval labels.

Rows of one group (a language) are the leaves of a tree, in the order of their identifier; ``fanout`` consecutive nodes become one
node above them until one remains, the group's subroot. The subroots, in the order of their group, are the leaves of one more tree, whose
last node is the root.

* **Labels.** A node carries the interval ``lo..hi`` of the leaf ranks it covers; with its level that is its whole position, so nobody
  follows pointers. A leaf covers its own rank. Ranks come from a range partitioning whose borders Spark samples: rows are numbered inside
  their range, and one line per range carries the count before it, so a group that holds a third of the table is never in one task.
* **Levels.** The nodes of one level are made from those below by the bucket ``lo div fanout^level``, at most ``fanout`` rows a bucket. Each
  level is written once, with the children that a node covers; it has an eighth of the rows of the level below.
* **Ancestors.** From the top down, the nodes of a level meet the written ones of that level by tree and bucket, where the interval of one
  contains that of the other (``attached``); a node then hands its path to its children. So a path is made once for all leaves below a node.
* **Siblings** of a child are what its parent covers less its own interval: the children that end before it and those that begin
  after it. A path is the list of these pairs from a node up to the root.

A proof is checked by folding the path: the digest so far goes between the siblings to its left and right.

Digests: a field is ``-`` if null, else its length in UTF-8 bytes, ``:`` and the value; a leaf is the SHA-256 of its fields put together, a
node that of its children's digests as hexadecimal text.

Defined results: rows without identifier come first; rows with one identifier are in the order of their leaf digests; repeated rows are
leaves of their own; a null group is a group of its own, before all others, and differs from the empty text; an empty table has no
rows and no root; columns that are not among the fields do not matter, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from assay.llm.common import documents, register, stored

FANOUT = 8
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
RANGE_ROWS = 500_000
SMALL = 100_000  # lines of some 40 bytes that may be broadcast
TAMPERED = 3     # of the checked rows, those whose crc32 this number divides have their text changed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return hashed(*map(field, values))


def few(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """A written table of narrow lines, broadcast if it was counted to be small."""
    return F.broadcast(df) if df.count() <= limit else df


def ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Leaves of each ``tree`` with their rank from 0 (``lo``) in the given order, and the number ``n`` of leaves of the tree.

    ``leaves`` is a written table. Its column ``line`` (a number of the row) parts rows that are equal in all else.
    """
    parts = max(1, ceil(leaves.count() / RANGE_ROWS))
    ranges = stored(leaves.repartitionByRange(parts, "tree", *order, "line").withColumn("range", F.spark_partition_id()), "merkle-ranges")
    counts = ranges.groupBy("tree", "range").agg(F.count(F.lit(1)).alias("c"))
    along = W.partitionBy("tree").orderBy("range")
    before = stored(counts.select("tree", "range", (F.sum("c").over(along) - F.col("c")).alias("before"), F.sum("c").over(W.partitionBy("tree")).alias("n")), "merkle-before")
    inside = F.row_number().over(W.partitionBy("tree", "range").orderBy(*order, "line"))
    return ranges.withColumn("at", inside - 1).join(few(before), ["tree", "range"]).withColumn("lo", F.col("before") + F.col("at")).drop("range", "before", "at", "line")


@dataclass
class Tree:
    """Trees by level: ``levels[k]`` has the nodes (tree, n, lo, hi, digest) and, above the leaves, the ``children`` each covers."""
    levels: list[DataFrame]
    fanout: int

    @staticmethod
    def build(leaves: DataFrame, fanout: int = FANOUT) -> "Tree":
        """From ranked leaves (tree, n, lo, digest and any other columns, which the first level's children carry)."""
        base = leaves.withColumn("hi", F.col("lo"))
        levels = [base]
        largest = base.agg(F.max("n")).first()[0] or 0
        width = 1
        while largest > width:
            width *= fanout
            below = levels[-1]
            carried = F.struct("lo", "hi", *[c for c in below.columns if c not in ("tree", "n", "lo", "hi", "children")])
            made = below.where(F.col("n") > width // fanout).groupBy("tree", "n", F.expr(f"lo DIV {width}L").alias("bucket")).agg(
                F.array_sort(F.collect_list(carried)).alias("children"))
            levels.append(stored(made.select(
                "tree", "n", (F.col("bucket") * width).alias("lo"), F.element_at("children", -1)["hi"].alias("hi"),
                F.sha2(F.array_join(F.col("children.digest"), "").cast("binary"), 256).alias("digest"), "children"), "merkle-level"))
        return Tree(levels, fanout)

    def tops(self, level: int) -> DataFrame:
        """The nodes of this level that are the last of their tree."""
        width = self.fanout ** level
        low = F.lit(True) if level == 0 else F.col("n") > width // self.fanout
        return self.levels[level].where(low & (F.col("n") <= width))

    def roots(self) -> DataFrame:
        out = None
        for level in range(len(self.levels)):
            found = self.tops(level).select("tree", "digest")
            out = found if out is None else out.unionByName(found)
        return out

    def attached(self, level: int, above: DataFrame) -> DataFrame:
        """Children of the nodes of ``level`` with their paths; ``above`` (tree, lo, hi, path) are nodes of the level with theirs.

        The containment join: a node meets those of its tree and bucket whose interval contains its own.
        """
        bucket = F.expr(f"lo DIV {self.fanout ** level}L")
        nodes = self.levels[level].select("tree", "lo", "hi", "children", bucket.alias("bucket")).alias("a")
        paths = above.select("tree", "lo", "hi", "path", bucket.alias("bucket")).alias("b")
        met = nodes.join(paths, (F.col("a.tree") == F.col("b.tree")) & (F.col("a.bucket") == F.col("b.bucket"))
                         & (F.col("b.lo") <= F.col("a.lo")) & (F.col("a.hi") <= F.col("b.hi"))).select(F.col("a.tree").alias("tree"), "children", "path")
        child = met.select("tree", "children", "path", F.explode("children").alias("child"))
        beside = lambda test: F.array_join(F.transform(F.filter("children", test), lambda x: x["digest"]), "")
        step = F.struct(beside(lambda x: x["hi"] < F.col("child.lo")).alias("left"), beside(lambda x: x["lo"] > F.col("child.hi")).alias("right"))
        return child.select("tree", "child.*", F.concat(F.array(step), F.col("path")).alias("path"))

    def paths(self, start: DataFrame) -> DataFrame:
        """All leaves, with what they carry and their ``path``; ``start`` (tree, path) is the path above each tree's last node."""
        start = few(stored(start, "merkle-start"))
        carried = [c for c in self.levels[0].columns if c not in ("n", "children")]
        above = None
        for level in range(len(self.levels) - 1, -1, -1):
            kept = carried if level == 0 else ["tree", "lo", "hi"]
            tops = self.tops(level).select(*kept).join(start, "tree").select(*kept, "path")
            above = tops if above is None else tops.unionByName(above.select(*kept, "path"))
            if level:
                above = self.attached(level, above if level > 3 else stored(above, "merkle-paths"))
        return above


PATH = "array<struct<left:string,right:string>>"


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, digest, lambda so_far, step: hashed(step["left"], so_far, step["right"]))


def proof_text(path: Column) -> Column:
    """All digests of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def manifest(leaves: DataFrame, order: list[str], fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """Proofs and trees over leaves with ``grp`` (text), ``digest``, the order columns and any other columns.

    Gives one row per leaf (all columns, ``subroot``, ``root``, ``path``) and one row per group (``grp, digest``).
    """
    spark = leaves.sparkSession
    named = F.coalesce(F.concat(F.lit("="), "grp"), F.lit(""))  # null before all others, and unlike the empty text
    rows = stored(leaves.select(named.alias("tree"), *[c for c in leaves.columns if c != "grp"], F.monotonically_increasing_id().alias("line")), "merkle-leaves")
    trees = Tree.build(stored(ranked(rows, [*order, "digest"]), "merkle-ranked"), fanout)
    subroots = stored(trees.roots(), "merkle-subroots")
    upper = Tree.build(stored(ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest", F.lit(0).alias("line")), ["group"]), "merkle-upper"), fanout)
    nothing = spark.range(1).select(F.lit("").alias("tree"), F.array().cast(PATH).alias("path"))
    above = stored(upper.paths(nothing).join(F.broadcast(upper.roots().withColumnRenamed("digest", "root")), "tree").select(
        F.col("group").alias("tree"), F.col("digest").alias("subroot"), "root", "path"), "merkle-above")
    proofs = trees.paths(above.select("tree", "path")).drop("lo", "hi").join(few(above.select("tree", "subroot", "root")), "tree")
    group = F.when(F.col("tree") != "", F.substr("tree", F.lit(2)))
    return proofs.withColumn("grp", group).drop("tree"), subroots.select(group.alias("grp"), "digest")


def leaves_of(docs: DataFrame, fields: list[str] = FIELDS, id_col: str = "doc_id", group: str = "lang", text_col: str = "text", altered_every: int = TAMPERED) -> DataFrame:
    """Leaves of a documents table: ``doc_id, grp, digest`` and ``altered``, the digest of a tampered row (null: as it was)."""
    col = lambda c: F.col(f"`{c}`")
    lowered = F.translate(col(text_col).cast("string"), UPPER, LOWER)
    chosen = F.pmod(F.crc32(col(id_col).cast("string").cast("binary")), F.lit(altered_every)) == 0
    return docs.select(
        col(id_col).alias("doc_id"), col(group).cast("string").alias("grp"), leaf([col(c) for c in fields]).alias("digest"),
        F.when(chosen & col(text_col).rlike("[A-Z]"), leaf([lowered if c == text_col else col(c) for c in fields])).alias("altered"))


def verified(docs: DataFrame, fanout: int = FANOUT, **columns) -> DataFrame:
    """One row per row of ``docs``: its leaf, subroot, root, proof digest, and whether the (tampered) row still folds to the root."""
    proofs, _ = manifest(leaves_of(docs, **columns), ["doc_id"], fanout)
    return proofs.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", hashed(proof_text(F.col("path"))).alias("proof_sha256"),
        folded(F.coalesce("altered", "digest"), F.col("path")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_tree(prefix: str, levels: int) -> str:
    """Levels and, from the top down, the siblings of every node; names x0, x1, … and y0, y1, …"""
    out = []
    for k in range(1, levels + 1):
        out.append(f"""{prefix}{k} AS MATERIALIZED (SELECT tree, i // {FANOUT} AS i, count(*) AS c, sha256(string_agg(digest, '' ORDER BY i)) AS digest
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS m FROM {prefix}{k - 1}) WHERE m > 1 GROUP BY ALL),""")
    return "\n".join(out)


def _sql_siblings(prefix: str, levels: int) -> str:
    """For each leaf and level the digests beside its ancestor there, with the place of the ancestor among them."""
    parts = [f"SELECT tree, {k} AS level, i, string_agg(digest, '') OVER r AS run, i % {FANOUT} AS place, count(*) OVER (PARTITION BY tree) AS m FROM {prefix}{k} "
             f"WINDOW r AS (PARTITION BY tree, i // {FANOUT} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)" for k in range(levels)]
    return f"{prefix}s AS MATERIALIZED (SELECT tree, level, i, run[:place * 64] AS lft, run[place * 64 + 65:] AS rgt FROM (" + " UNION ALL ".join(parts) + ") WHERE m > 1),"


def _sql(levels: int = 10, upper: int = 4) -> str:
    """Trees of up to ``fanout ** levels`` leaves and ``fanout ** upper`` groups."""
    enc = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    bits = "".join(f"CASE WHEN c{j - 1} % 2 = 1 THEN xor(c{j - 1} // 2, 3988292384) ELSE c{j - 1} // 2 END AS c{j}, " for j in range(1, 9))
    fold = lambda prefix, k, d: f"CASE WHEN {prefix}{k}.level IS NULL THEN {d} ELSE sha256({prefix}{k}.lft || {d} || {prefix}{k}.rgt) END"
    steps = []
    previous = "a"
    for prefix, many, key in (("x", levels, "i"), ("z", upper, "zi")):
        for k in range(many):
            name = f"f{prefix}{k}"
            tree = "o.tree = j.tree" if prefix == "x" else "true"
            steps.append(f"""{name} AS (SELECT o.* REPLACE (CASE WHEN j.level IS NULL THEN o.cur ELSE sha256(j.lft || o.cur || j.rgt) END AS cur, o.proof || coalesce(j.lft || j.rgt, '') AS proof)
  FROM {previous} o LEFT JOIN {prefix}s j ON {tree} AND j.level = {k} AND j.i = o.{key} // {FANOUT ** k}),""")
            previous = name
    return f"""
WITH RECURSIVE crc AS (SELECT doc_id, encode(doc_id::VARCHAR) AS b, 0 AS p, 4294967295::BIGINT AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL SELECT doc_id, b, p + 1, c8 FROM (SELECT *, xor(c, ascii(substr(decode(b), p + 1, 1))::BIGINT) AS c0, {bits} FROM crc WHERE p < octet_length(b))),
marks AS (SELECT doc_id, xor(c, 4294967295) % {TAMPERED} = 0 AS chosen FROM crc WHERE p = octet_length(b)),
d AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({' || '.join(enc(c) for c in FIELDS)}) AS digest,
  CASE WHEN coalesce(chosen, false) THEN sha256({' || '.join(enc(low if c == 'text' else c) for c in FIELDS)}) END AS altered FROM documents LEFT JOIN marks USING (doc_id)),
x0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS i FROM d),
{_sql_tree('x', levels)}
{_sql_siblings('x', levels)}
sub AS MATERIALIZED (SELECT tree, digest FROM ({' UNION ALL '.join(f"SELECT tree, digest, count(*) OVER (PARTITION BY tree) AS m, {k} AS k FROM x{k}" for k in range(levels + 1))}) WHERE m = 1 QUALIFY row_number() OVER (PARTITION BY tree ORDER BY k) = 1),
z0 AS MATERIALIZED (SELECT 0 AS tree, tree AS grp, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS i FROM sub),
{_sql_tree('z', upper)}
{_sql_siblings('z', upper)}
top AS MATERIALIZED (SELECT digest AS root FROM ({' UNION ALL '.join(f"SELECT digest, count(*) OVER () AS m, {k} AS k FROM z{k}" for k in range(upper + 1))}) WHERE m = 1 ORDER BY k LIMIT 1),
a AS (SELECT x0.doc_id, x0.tree, x0.i, z0.i AS zi, x0.digest AS leaf, z0.digest AS subroot, root, coalesce(altered, x0.digest) AS cur, '' AS proof
  FROM x0 JOIN z0 ON x0.tree = z0.grp, top),
{' '.join(steps)[:-1]}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified FROM {previous}"""


@register("op13_merkle_manifest", _sql())
def op13_merkle_manifest(spark: SparkSession, root: str) -> DataFrame:
    return verified(documents(spark, root))

"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations only.

The corpus is a tree: domain, language, source. A budget of tokens at the root is split among the children of each node by their
weights. A child gets no more than the tokens it can give (its documents times the epochs allowed); what it leaves goes to its
siblings by their weights, and only when all of them are full does the shortage show one level higher, where it
is spread among the siblings of their parent in the same way. Since a node's target never exceeds what it can give, filling level
by level from the root does exactly this.

Filling one group of siblings needs no loop: in the order of capacity per weight, a child is full if its share of what the children
before it leave reaches its capacity; from the first that is not full on, all share what is left by weight. Targets are whole tokens, rounded
down; a group leaves less than one token a child unassigned.

A leaf whose budget is several times its size takes all its documents that often; the rest is a token prefix of one more
epoch, in the order of a seeded hash of (seed, epoch, document). The prefix is found without sorting a leaf in one task: the
hashes are cut into ranges, the tokens of each range are added up, and only rows of the range in which the budget ends are
put in order. The number of ranges follows from the largest leaf, so a range holds some thousands of documents however hot the leaf.

The tree has one row per leaf; it is broadcast if it has at most ``SMALL`` of them, else joined by shuffle, where Spark splits skewed
partitions.

Defined results: a null domain, language or source is a child named ''; a null text counts as empty; a document without words has no
tokens and is taken with the prefix it falls into; names without a given weight weigh 1, weights below 0 are an error; rows with one doc_id are
ordered by their text's digest, equal ones by nothing (either may be the one cut); an empty table or a budget of 0 gives no rows; columns that clash with the
names used here are set aside by ``mixed``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from assay.llm.common import documents, register, stored, whole

LEVELS = ["domain", "lang", "source"]
SMALL = 50_000
RANGE_ROWS = 2_000
MOST_RANGES = 16  # as a power of two: 65,536 ranges a leaf, whose running sum is one small task; a range then holds 1/65,536 of the leaf
SEED = 17
SHARE = 0.5      # of all tokens of the corpus, the budget of the registered query
EPOCHS = 2

#: Target weights of the registered query and the pipeline, by name within its level.
WEIGHTS = {"domain": {"web": 4, "books": 3, "code": 2, "forum": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 2}}
DOMAINS = ["web", "books", "code", "forum"]


def domain_of(source: Column) -> Column:
    """Domain of a source of the documents table: the number in its name modulo four."""
    number = F.coalesce(F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]+)$", 1), F.lit(""))
    return F.element_at(F.array(*map(F.lit, DOMAINS)), (F.when(number == "", F.lit("0")).otherwise(F.right(number, F.lit(9))).cast("int") % 4 + 1))


def word_count(text: Column) -> Column:
    """Number of words: white space runs between words are found once, without making the words."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def weight_of(level: str, weights: dict[str, dict[str, int]]) -> Column:
    given = weights.get(level, {})
    if any(w < 0 for w in given.values()):
        raise ValueError("weights must not be below 0")
    out = F.lit(1).cast("long")
    for name, weight in given.items():
        out = F.when(F.col(level) == name, F.lit(weight).cast("long")).otherwise(out)
    return out


def fill(children: DataFrame, parent: list[str]) -> DataFrame:
    """Add ``target`` to siblings (columns: parent, name, weight, capacity, and ``budget`` of their parent)."""
    siblings = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    name = [c for c in LEVELS if c in children.columns]
    by_need = [F.when(F.col("weight") > 0, F.col("capacity").cast("decimal(38,12)") / F.col("weight")).otherwise(F.lit(0).cast("decimal(38,12)")).asc(), *name]
    before = siblings.orderBy(*by_need).rowsBetween(W.unboundedPreceding, -1)
    upward = siblings.orderBy(*by_need).rowsBetween(W.currentRow, W.unboundedFollowing)
    usable = F.when(F.col("weight") > 0, F.col("capacity")).otherwise(F.lit(0).cast("long"))
    left = F.col("budget") - F.coalesce(F.sum(usable).over(before), F.lit(0))
    out = children.withColumns({"__left": left, "__weights": F.sum("weight").over(upward)})
    share = F.expr("CASE WHEN __weights > 0 AND __left > 0 THEN CAST(CAST(__left AS DECIMAL(38,0)) * weight DIV __weights AS BIGINT) ELSE 0L END")
    # Full children come first; the first one that is not full fixes what remains and its weights for all after it.
    out = out.withColumn("__full", (F.col("weight") == 0) | (share >= F.col("capacity")))
    out = out.withColumns({
        "__rest": F.min(F.when(~F.col("__full"), F.struct(F.row_number().over(siblings.orderBy(*by_need)).alias("i"), "__left", "__weights"))).over(siblings)})
    final = F.expr("CAST(CAST(__rest.__left AS DECIMAL(38,0)) * weight DIV __rest.__weights AS BIGINT)")
    return out.withColumn("target", F.when(F.col("weight") == 0, F.lit(0).cast("long")).when(F.col("__full"), F.col("capacity")).otherwise(final)).drop(
        "__left", "__weights", "__full", "__rest")


def budgets(leaves: DataFrame, budget: Column, weights: dict[str, dict[str, int]], epochs: int) -> DataFrame:
    """Leaves (levels, ``docs``, ``tokens``) with their ``target``, from the root down."""
    capacity = leaves.withColumn("capacity", F.col("tokens") * epochs)
    # A name of weight 0 gives nothing, so nothing below it counts towards what its parent can give.
    for level in LEVELS:
        capacity = capacity.withColumn("capacity", F.when(weight_of(level, weights) > 0, F.col("capacity")).otherwise(F.lit(0).cast("long")))
    above, parent = None, []
    for depth in range(1, len(LEVELS) + 1):
        names = LEVELS[:depth]
        nodes = capacity.groupBy(*names).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight_of(names[-1], weights))
        if above is None:
            nodes = nodes.withColumn("budget", F.least(budget, F.sum("capacity").over(W.partitionBy(F.lit(0)))))
        else:
            nodes = nodes.join(above, parent)
        parent = names
        above = fill(nodes, names[:-1]).select(*names, F.col("target").alias("budget"))
    return leaves.join(above.withColumnRenamed("budget", "target"), LEVELS)


def order_key(epoch: Column, seed: int) -> Column:
    """Position of a document in an epoch: 15 hexadecimal digits of a seeded digest."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("mark"))), 1, 15), 16, 10).cast("long")


def selection(docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS, weights: dict[str, dict[str, int]] = WEIGHTS, seed: int = SEED,
              tokens: int | None = None, domain: Column | None = None) -> DataFrame:
    """One row per taken document and epoch: ``row, doc_id, domain, lang, source, n_tokens, epoch, taken``.

    ``taken`` is the number of tokens to use, less than ``n_tokens`` only for the last document of a leaf's prefix. The budget is
    ``tokens``, or ``share`` of all tokens. ``row`` tells rows of one doc_id apart.
    """
    spark = docs.sparkSession
    text = whole(F.col("text").cast("string"))
    sized = stored(docs.select(
        "doc_id", (domain_of(F.col("source")) if domain is None else domain).alias("domain"), whole("lang").alias("lang"), whole("source").alias("source"),
        word_count(text).alias("n_tokens"), F.md5(text).alias("mark")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("domain", F.lit("")).alias("domain"), "lang", "source", "n_tokens", "mark"), "mix-sizes")
    leaves = stored(sized.groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens")), "mix-leaves")
    total = leaves.agg(F.sum("tokens").alias("tokens"), F.max("docs").alias("docs"), F.count(F.lit(1)).alias("leaves")).first()
    budget = F.lit(int((total.tokens or 0) * share) if tokens is None else tokens).cast("long")
    plan = stored(budgets(leaves, budget, weights, epochs).select(
        *LEVELS, F.expr("CASE WHEN tokens > 0 THEN target DIV tokens ELSE 0L END").alias("full"),
        F.expr("CASE WHEN tokens > 0 THEN target % tokens ELSE 0L END").alias("rest")).where("full > 0 OR rest > 0"), "mix-plan")
    plan = F.broadcast(plan) if total.leaves <= SMALL else plan
    ranges = 1 << min(MOST_RANGES, max(0, math.ceil(math.log2(max(1, (total.docs or 0) / RANGE_ROWS)))))
    placed = sized.join(plan, LEVELS).withColumn("key", order_key(F.col("full"), seed)).withColumn(
        "range", F.shiftright(F.col("key"), 60 - int(math.log2(ranges))))
    # Tokens before each range of a leaf's last epoch: as many rows as ranges, whatever the number of documents.
    sums = placed.groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("t"))
    upto = W.partitionBy(*LEVELS).orderBy("range")
    before = sums.withColumn("before", F.sum("t").over(upto) - F.col("t")).select(*LEVELS, "range", "before", "t")
    before = stored(before, "mix-ranges")
    before = F.broadcast(before) if total.leaves * ranges <= SMALL else before
    ranged = placed.join(before, [*LEVELS, "range"])
    out = [*["row", "doc_id", *LEVELS, "n_tokens"]]
    whole_epochs = placed.where("full > 0").select(*out, F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("epoch"), F.col("n_tokens").alias("taken"))
    inside = ranged.where("before + t < rest").select(*out, F.col("full").alias("epoch"), F.col("n_tokens").alias("taken"))
    within = W.partitionBy(*LEVELS, "range").orderBy("key", "doc_id", "mark", "row")
    edge = ranged.where("before < rest AND before + t >= rest").withColumn("at", F.col("before") + F.sum("n_tokens").over(within) - F.col("n_tokens")).where("at < rest").select(
        *out, F.col("full").alias("epoch"), F.least(F.col("n_tokens"), F.col("rest") - F.col("at")).alias("taken"))
    return whole_epochs.unionByName(inside).unionByName(edge)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The taken documents, whole and once each, all columns as they were (the pipeline's form: a text is not cut)."""
    chosen = stored(selection(docs, **options).select(F.col("doc_id").alias("__id")).distinct(), "mix-chosen")
    few = chosen.count() <= 4 * SMALL  # 200,000 identifiers, 2 MB
    return docs.join(F.broadcast(chosen) if few else chosen, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")


def _sql_weight(level: str) -> str:
    cases = " ".join(f"WHEN '{n}' THEN {w}" for n, w in WEIGHTS.get(level, {}).items())
    return f"CASE {level} {cases} ELSE 1 END" if cases else "1"


def _sql_fill(depth: int) -> str:
    names, parent = LEVELS[:depth], LEVELS[:depth - 1]
    by, group = ", ".join(names), f"PARTITION BY {', '.join(parent)}" if parent else ""
    source = f"JOIN f{depth - 1} USING ({', '.join(parent)})" if parent else "CROSS JOIN (SELECT least(sum(tokens * {epochs}), sum(tokens) * {share} // 1000) AS budget FROM leaves)"
    return f"""
n{depth} AS (SELECT {by}, capacity, weight, budget FROM (SELECT {by}, sum(tokens * {{epochs}}) AS capacity, {_sql_weight(names[-1])} AS weight FROM leaves GROUP BY {by}) {source}),
a{depth} AS (SELECT *, (budget - coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::HUGEINT AS rest,
  (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS ws, row_number() OVER o AS i
  FROM n{depth} WINDOW o AS ({group} ORDER BY capacity::DOUBLE / weight, {by})),
b{depth} AS (SELECT *, CASE WHEN rest > 0 THEN rest * weight // ws ELSE 0 END >= capacity AS is_full FROM a{depth}),
f{depth} AS (SELECT {by}, (CASE WHEN is_full THEN capacity ELSE (min({{{{'i': i, 'rest': rest, 'ws': ws}}}}) FILTER (NOT is_full) OVER w)['rest'] * weight // (min({{{{'i': i, 'rest': rest, 'ws': ws}}}}) FILTER (NOT is_full) OVER w)['ws'] END)::BIGINT AS budget
  FROM b{depth} WINDOW w AS ({group or ''})),"""


SQL = ("""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, md5(coalesce(text, '')) AS mark,
  ['web', 'books', 'code', 'forum'][coalesce(try_cast(right(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1), 9) AS INT), 0) % 4 + 1] AS domain,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM d GROUP BY ALL),""" + "".join(map(_sql_fill, (1, 2, 3))) + """
p AS (SELECT f3.*, CASE WHEN tokens > 0 THEN (budget // tokens)::BIGINT ELSE 0 END AS whole_epochs, CASE WHEN tokens > 0 THEN (budget % tokens)::BIGINT ELSE 0 END AS part
  FROM f3 JOIN leaves USING (domain, lang, source)),
e AS (SELECT d.*, whole_epochs, part, ('0x' || substr(md5({seed} || ':' || whole_epochs || ':' || doc_id || ':' || mark), 1, 15))::BIGINT AS k FROM d JOIN p USING (domain, lang, source)),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, doc_id, mark ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_tokens AS before FROM e)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(whole_epochs)) AS epoch, n_tokens AS taken FROM e
UNION ALL
SELECT doc_id, domain, lang, source, n_tokens, whole_epochs, least(n_tokens, part - before)::BIGINT FROM c WHERE before < part
""").format(epochs=EPOCHS, share=int(SHARE * 1000), seed=SEED)


@register("op1_source_mix", SQL)
def op1_source_mix(spark: SparkSession, root: str) -> DataFrame:
    return selection(documents(spark, root)).drop("row")

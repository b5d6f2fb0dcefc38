"""Benchmark decontamination by winnowing, in DataFrame operations only.

A window is ``span`` (ten) consecutive words of a benchmark item; an item of fewer words, but not none, is one window. A word of a document
that lies inside any occurrence of a window is hit.

1. **Fingerprints.** Every ``gram`` (five) consecutive words have a hash. Of each run of ``span - gram + 1`` hashes the smallest is kept, with its
   place. A document and an item that share ``span`` words have the same run of hashes there, so both keep its smallest one: no shared
   window can be missed, while only about two of seven hashes are kept. The place is found again from three bits of the kept number, which is
   why the choice among equal hashes of one run does not matter.
2. **Join.** The fingerprints of the documents meet the distinct ones of the benchmark (a semi-join: a fingerprint of many items
   or at many places of one meets once).
3. **Extension.** A kept place lies in at most ``span - gram + 1`` windows of its document. Their words are made from the whole text and joined
   with the benchmark's windows as text, so hashes decide nothing. Only documents with a hit are read again, of equal texts one.
4. **Items.** Documents that hold the same set of windows have the same items; the items are listed once per such set.

Items shorter than ``span`` have no full run of hashes. Their windows are found by an anchor, their first words as many as the shortest item has;
only where the benchmark has such items, every place of a document is an anchor too.

Defined results: a null or empty text, or one without words, has no words and no hits; an item without words has no window; an item without
item_id has the identifier ''; rows with one item_id are one item with the windows of all; rows with one doc_id, or repeated rows, have a
result each; an empty benchmark hits nothing; an empty table gives no rows; other columns do not matter. A task holds the words
of one text at a time, whatever its length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from assay.llm.common import documents, register, stored, whole
from assay.sources.readers import read_table

BENCHMARK = "item_id bigint, text string"
SPAN, GRAM = 10, 5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SMALL = 500_000  # counted rows of up to 8 bytes, or a fifth as many wider ones, that may be broadcast


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression over a value that is worked out once (a nested lambda would work it out for every element)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case. A text of one byte a character takes the shorter way to the same letters."""
    plain = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(plain, SEPARATORS), "")


def every(first: int, last: Column) -> Column:
    """The numbers from first to last, none if last is smaller."""
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))


def grams(w: Column, size: int) -> Column:
    """A number for each ``size`` consecutive words: a hash, whose last three bits are those of the place (from 1)."""
    return F.transform(every(1, F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size)).bitwiseAND(F.lit(-8)).bitwiseOR(i.bitwiseAND(F.lit(7))))


def fingerprints(w: Column, span: int = SPAN, gram: int = GRAM) -> Column:
    """Smallest gram of every run of ``span - gram + 1``, each kept one once: array of (h, p), p from 1."""
    run = span - gram + 1
    if not 1 <= run <= 8:
        raise ValueError("a window must be at most seven words longer than a gram")
    least = lambda g: F.transform(every(1, F.size(g) - (run - 1)), lambda i: F.array_min(F.slice(g, i, run)))
    # Neighbouring runs share all but one place each, so equal numbers in them are the same place.
    fresh = lambda m: F.filter(every(1, F.size(m)), lambda i: (i == 1) | (F.element_at(m, i) != F.element_at(m, i - 1)))
    at = lambda m, i: (i + (F.element_at(m, i) - i).bitwiseAND(F.lit(7))).cast("int")
    kept = lambda m: F.transform(fresh(m), lambda i: F.struct(F.shiftright(F.element_at(m, i), 3).alias("h"), at(m, i).alias("p")))
    return bound(grams(w, gram), lambda g: bound(least(g), kept))


def anchors(w: Column, size: int) -> Column:
    return F.transform(grams(w, size), lambda g, i: F.struct(F.shiftright(g, 3).alias("h"), (i + 1).cast("int").alias("p")))


def joined(w: Column, start: Column, size: Column | int) -> Column:
    return F.array_join(F.slice(w, start, size), " ")


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """A written table of narrow rows, broadcast if it was counted to be small, else joined by shuffle (where Spark splits hot keys)."""
    return F.broadcast(df) if df.count() <= rows else df


def windows_of(items: DataFrame, span: int = SPAN) -> DataFrame:
    """Windows of every item: ``item, w`` (its words) and ``size``; stored."""
    cut = lambda w: F.when(F.size(w) >= span, F.transform(every(1, F.size(w) - (span - 1)), lambda i: joined(w, i, span))).when(
        F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))
    made = items.select("item", F.explode(bound(words(F.col("t")), lambda w: F.transform(cut(w), lambda x: F.struct(x.alias("w"), F.least(F.size(w), F.lit(span)).alias("size"))))).alias("x"))
    return stored(made.select("item", "x.w", "x.size").distinct(), "windows")


def contaminated(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    col = lambda c: F.col(f"`{c}`")
    items = benchmark.select(F.coalesce(col(item_col).cast("string"), F.lit("")).alias("item"), whole(col(item_text).cast("string")).alias("t"))
    texts = docs.select(col(id_col).alias("doc_id"), whole(col(text_col).cast("string")).alias("t")).withColumn("mark", F.sha2(F.col("t").cast("binary"), 256))
    listed = windows_of(items, span)
    sizes = sorted(r.size for r in listed.select(F.col("size").alias("size")).distinct().collect())  # at most ``span`` numbers
    short = [s for s in sizes if s < span]
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    prints = lambda w: F.struct(F.size(w).alias("n"), fingerprints(w, span, gram).alias("f"), (anchors(w, short[0]) if short else none).alias("a"))
    read = stored(texts.select("doc_id", "mark", bound(words(F.col("t")), prints).alias("x")).select("doc_id", "mark", F.col("x.n").cast("long").alias("n_words"), "x.f", "x.a"), "prints")

    own = listed.where(F.col("size") == span).select(F.explode(fingerprints(F.split("w", " "), span, gram)).alias("x"))
    known = stored(own.select("x.h").distinct(), "benchmark-prints")
    at = lambda column: read.select("doc_id", "mark", F.col("n_words").cast("int").alias("n"), F.inline(column))
    one = lambda s, size: F.struct(s.alias("s"), F.lit(size).alias("size"))
    near = at("f").join(small(known), "h", "left_semi").select("doc_id", "mark", F.explode(F.transform(
        F.sequence(F.greatest(F.col("p") - (span - gram), F.lit(1)), F.least(F.col("p"), F.col("n") - (span - 1))), lambda s: one(s, span))).alias("x"))
    if short:
        starts = listed.where(F.col("size") < span).select(F.shiftright(F.element_at(grams(F.split("w", " "), short[0]), 1), 3).alias("h"))
        begun = at("a").join(small(stored(starts.distinct(), "benchmark-anchors")), "h", "left_semi")
        near = near.unionByName(begun.select("doc_id", "mark", F.explode(F.filter(F.array(*[one(F.col("p"), s) for s in short]), lambda x: x["s"] + x["size"] - 1 <= F.col("n"))).alias("x")))
    spots = near.groupBy("mark", "x").agg(F.min("doc_id").alias("first")).groupBy("mark").agg(F.min("first").alias("first"), F.collect_list("x").alias("spots"))
    spots = stored(spots, "spots")
    places = spots.agg(F.sum(F.size("spots") + 8)).first()[0] or 0  # a place is 16 bytes

    once = texts.withColumnRenamed("mark", "m").join(F.broadcast(spots) if places <= SMALL else spots, (F.col("m") == F.col("mark")) & F.col("doc_id").eqNullSafe(F.col("first")))
    shown = bound(words(F.col("t")), lambda w: F.transform("spots", lambda x: F.struct(x["s"].alias("s"), x["size"].alias("size"), joined(w, x["s"], x["size"]).alias("w"))))
    numbered = stored(listed.select("w").distinct().withColumn("id", F.monotonically_increasing_id()), "distinct-windows")
    found = stored(once.select("mark", F.inline(shown)).join(small(numbered, SMALL // 5), "w").select("mark", "s", "size", "id").distinct(), "found")

    # Words covered: what each occurrence adds to those that begin before it.
    reach = F.max(F.col("s") + F.col("size")).over(W.partitionBy("mark").orderBy("s", "size").rowsBetween(W.unboundedPreceding, -1))
    added = F.greatest(F.col("s") + F.col("size") - F.greatest(F.col("s"), F.coalesce(reach, F.lit(0))), F.lit(0))
    by_text = found.withColumn("added", added).groupBy("mark").agg(F.sum("added").alias("n_hit"), F.array_sort(F.collect_set("id")).alias("ids"))
    by_text = stored(by_text.withColumn("held", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)), "hits")
    sets = by_text.groupBy("held").agg(F.first("ids").alias("ids")).select("held", F.explode("ids").alias("id"))
    of_window = listed.join(numbered, "w").select("id", "item")
    lists = sets.join(of_window, "id").groupBy("held").agg(F.array_sort(F.collect_set("item")).alias("items")).select(
        "held", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    results = stored(by_text.select("mark", "n_hit", "held").join(lists, "held").drop("held"), "contaminated")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return read.select("doc_id", "mark", "n_words").join(small(results, SMALL // 10), "mark", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", nothing).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents without a benchmark window, all columns as they were (of rows with one doc_id all go if one is hit)."""
    hit = contaminated(docs, benchmark, **options).where("contaminated").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(small(stored(hit, "hit-ids")), F.col(f"`{options.get('id_col', 'doc_id')}`").eqNullSafe(F.col("__id")), "left_anti")


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
b AS (SELECT DISTINCT item, {SPAN} AS size, array_to_string(w[s:s + {SPAN - 1}], ' ') AS t FROM (SELECT item, w, unnest(range(1, len(w) - {SPAN - 2})) AS s FROM i WHERE len(w) >= {SPAN})
  UNION SELECT item, len(w), array_to_string(w, ' ') FROM i WHERE len(w) BETWEEN 1 AND {SPAN - 1}),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT r, size, w, unnest(range(1, len(w) - size + 2)) AS s FROM d, (SELECT DISTINCT size FROM b)),
f AS MATERIALIZED (SELECT r, s, size, item FROM (SELECT r, s, size, array_to_string(w[s:s + size - 1], ' ') AS t FROM x) JOIN b USING (size, t)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + size)) AS p FROM (SELECT DISTINCT r, s, size FROM f)) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY encode(item))) AS items_sha256 FROM (SELECT DISTINCT r, item FROM f) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)
"""


@register("op11_benchmark_windows", SQL)
def op11_benchmark_windows(spark: SparkSession, root: str) -> DataFrame:
    return contaminated(documents(spark, root), read_table(spark, root, "benchmark", BENCHMARK))

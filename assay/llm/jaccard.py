"""Exact similarity join of documents on word shingles by set relations: index lists with skipped blocks, derived answers.

A document's set is its distinct five-word shingles. Two documents link when their Jaccard similarity is ``percent`` or more;
the result names each document's connected component. No candidate is ever dropped, whatever the size of a list or group.

1. **Sets that cannot link are put aside.** A shingle that occurs in one document only cannot be in an intersection, so a
   set of which more than a fifth occurs nowhere else has no partner. To count, map tasks send 4 bytes of each shingle to the task of its
   range, as one block per batch and range; a shingle found twice within a batch travels once, so a passage that a third
   of all documents share is one entry per batch. (A 4-byte clash inside a range can only keep a set in, never put it aside.)
2. **Equal sets are one.** The others are represented by their smallest doc_id from here on.
3. **Highly similar sets.** Sets are tied to a more central one (its shingles are the more frequent) that shares a smallest hash and is
   similar enough, verified exactly. A tied set is a link; only its difference from the head is kept.
4. **Index lists of the heads.** Shingles are ordered by frequency; a head enters the lists of its prefix. A list is cut into blocks by
   how many shingles remain after the entry's position. A probe visits only the blocks whose remainder can still give the
   overlap it needs; all others are skipped without being read. The bound leaves room for the sets tied to a head.
5. **Derived answers.** Heads p, q are compared once. For sets x, y tied to them the overlap follows from
   |x & y| = |p & q| - what p and q have and x or y lack + what x or y have beyond them, so only pairs that the sizes still
   allow are looked at, by their differences, and no pair within one head's group is ever formed.

Shingles are 64-bit hashes of the words; a set with 20,000 of them holds two equal ones with a chance of 1e-11.

Defined results: a null or empty text, or one without words, has no shingles, links with nothing and is its own component; a text of one to
four words has one shingle; rows with one doc_id are one document with one component, whatever their texts; a row without doc_id has no component and takes no
part; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assay.llm.common import batch_number, bounded_batches, documents, numbering, pack, partitions, register, release, small_batches, stored, unpack, whole
from assay.operators.graph import components
from assay.operators.ordered import sized

SHINGLE = 5
PERCENT = 80
SLACK = 2           # percent of its shingles that a tied set may share with others beyond its head
HASHES = 4          # smallest hashes by which a set looks for a head
BATCH = 1_500_000
CLASS = 1.25        # remainders within this factor lie in one block
FINE = 1.05         # needs within this factor lie in one part of a long block
LONG_BLOCK = 1_000  # entries from which a block is parted
SMALL = 200_000     # a list of so many (id, digest) rows, 5 MB, may be broadcast

MIX = np.uint64(0x9E3779B97F4A7C15)
SETS = "doc_id bigint, n_shingles long, shared long, d0 long, d1 long"


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of every text; ASCII letters in lower case, words split at ASCII white space."""
    known, numbers, starts = numbering(), [], [0]
    for text in texts:
        numbers.extend(map(known.__getitem__, text.lower().split()))
        starts.append(len(numbers))
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in known], dtype=np.uint64)
    words = hashes[np.array(numbers, dtype=np.int64)] if numbers else np.zeros(0, np.uint64)
    rolled = np.zeros(max(len(words) - size + 1, 0), dtype=np.uint64)
    for j in range(size):
        rolled = rolled * MIX + words[j:len(words) - size + 1 + j] if len(rolled) else rolled
    rolled = mixed(rolled + np.uint64(size))
    out = []
    for a, b in zip(starts, starts[1:]):
        if b - a >= size:
            out.append(np.unique(rolled[a:b - size + 1]))
        elif b > a:
            h = np.zeros(1, dtype=np.uint64)
            for w in words[a:b]:
                h = h * MIX + w
            out.append(mixed(h + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def digest(shingles: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return int(np.int64(np.uint64(d >> 64))), int(np.int64(np.uint64(d & (2**64 - 1))))


def text_column(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col).cast("string")).cast("binary").alias("t"))


def shared_counts(source: DataFrame, parts: int) -> DataFrame:
    """For every document its number of shingles, how many of them occur in another document too, and the digest of its set."""
    sent = "part int, batch long, block binary, docs binary"

    def map_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sequence, batch in enumerate(small_batches(batches, "t", BATCH)):
            sets = shingle_sets(batch.column("t").to_pylist())
            sizes = np.array([len(s) for s in sets])
            marks = [digest(s) for s in sets]
            every = np.concatenate(sets)
            order = np.argsort(every)
            ascending = every[order]
            first = np.flatnonzero(np.r_[True, ascending[1:] != ascending[:-1]]) if len(every) else np.zeros(0, np.int64)
            times = np.diff(np.r_[first, len(every)])
            alone = np.empty(len(every), dtype=bool)
            alone[order] = np.repeat(times == 1, times)
            owner = np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
            inside = np.bincount(owner[~alone], minlength=len(sets))
            number = batch_number(sequence)
            part_col, blocks, doc_col = [-1 - number % parts], [None], [pack(
                np.asarray(batch.column("doc_id").fill_null(0)), np.asarray(batch.column("doc_id").is_null()), sizes, inside, np.array(marks, dtype=np.int64))]

            def part(h):
                return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.uint16 if parts < 65536 else np.uint32)

            several = ascending[first[times > 1]]
            one, who = every[alone], owner[alone].astype(np.uint16 if len(sets) < 65536 else np.uint32)
            order = np.argsort(part(one), kind="stable")  # by range, then document
            one, who = one[order], who[order]
            at_one = np.searchsorted(part(one), np.arange(parts + 1))
            at_several = np.searchsorted(part(several), np.arange(parts + 1))
            one, several = one.astype(np.uint32), several.astype(np.uint32)
            for i in range(parts):
                a, b, c, d = at_one[i], at_one[i + 1], at_several[i], at_several[i + 1]
                if b > a or d > c:
                    part_col.append(i)
                    blocks.append(pack(one[a:b], who[a:b], several[c:d]))
                    doc_col.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(part_col, pa.int32()), pa.array([number] * len(part_col), pa.int64()),
                                              pa.array(blocks, pa.binary()), pa.array(doc_col, pa.binary())], names=["part", "batch", "block", "docs"])

    def reduce_side(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return frame
        entries = [unpack(b) for b in frame.block]
        every = np.sort(np.concatenate([x for one, _, several in entries for x in (one, several, several)]))
        again = np.unique(every[1:][every[1:] == every[:-1]])
        out = []
        for one, who, _ in entries:
            at = np.minimum(np.searchsorted(again, one), max(len(again) - 1, 0))
            out.append(pack(*np.unique(who[again[at] == one] if len(again) else who[:0], return_counts=True)))
        del entries, every, again
        release()
        return frame.assign(block=out)

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ids, missing, sizes, inside, marks = unpack(frame.docs[frame.docs.notna()].iloc[0])
        shared = inside.astype(np.int64)
        for block in frame.block.dropna():
            who, times = unpack(block)
            shared[who] += times
        return pd.DataFrame({"doc_id": pd.array(pd.Series(ids).mask(missing), dtype="Int64"), "n_shingles": sizes, "shared": shared,
                             "d0": marks.reshape(-1, 2)[:, 0], "d1": marks.reshape(-1, 2)[:, 1]})

    return source.mapInArrow(map_side, sent).groupBy("part").applyInPandas(reduce_side, sent).groupBy("batch").applyInPandas(merge, SETS)


def sets_of(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted sets (id, of a document ``first``, d0, d1), whole, with their smallest hashes."""
    keys = wanted.select("id", "first", "d0", "d1")
    picked = source.join(F.broadcast(keys) if wanted.count() <= SMALL else keys, F.col("doc_id") == F.col("first")).select("id", "d0", "d1", "t")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "t", BATCH):
            ids, d0, d1 = (batch.column(c).to_pylist() for c in ("id", "d0", "d1"))
            rows = [(i, s) for i, a, b, s in zip(ids, d0, d1, shingle_sets(batch.column("t").to_pylist())) if digest(s) == (a, b)]
            least = [[int(np.int64(np.min(mixed(s + np.uint64(k * 0x9E3779B9))))) for k in range(HASHES)] for _, s in rows]
            yield pa.RecordBatch.from_arrays([
                pa.array([i for i, _ in rows], pa.int64()), pa.array([len(s) for _, s in rows], pa.int32()),
                pa.array([s.view(np.int64) for _, s in rows], pa.list_(pa.int64())), pa.array(least, pa.list_(pa.int64()))], names=["id", "n", "tokens", "least"])

    # A doc_id may stand in several rows, with this text or others.
    return stored(picked.mapInArrow(make, "id long, n int, tokens array<long>, least array<long>").dropDuplicates(["id"]), "sets")


def ordered_sets(sets: DataFrame, percent: int) -> DataFrame:
    """Sets with the shingles that occur elsewhere too, rarest first, and how central the set is."""
    single = sets.select("id", "n", F.explode("tokens").alias("token"))
    often = single.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ordered = single.join(often, "token").groupBy("id", "n").agg(
        F.sort_array(F.collect_list(F.struct(F.col("df").cast("int").alias("df"), "token"))).alias("s"), F.sum(F.log2("df")).alias("weight"))
    return stored(ordered.where(F.size("s") * 100 >= percent * F.col("n")).select(
        "id", "n", F.col("s.token").alias("tokens"), (F.col("weight") / F.col("n")).alias("central")), "ordered")


def overlap(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b))


def linked(n_a: str, n_b: str, common: str, percent: int) -> Column:
    return F.col(common) * (100 + percent) >= percent * (F.col(n_a) + F.col(n_b))


def tied(ordered: DataFrame, least: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links found on the way to a head; and the tied sets (id, head, s, n, minus, plus)."""
    places = least.join(ordered.select("id", "central"), "id").select("id", "central", F.posexplode("least").alias("slot", "hash"))
    best = places.groupBy("slot", "hash").agg(F.max(F.struct("central", (-F.col("id")).alias("minus_id"))).alias("best"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    pairs = places.join(best, ["slot", "hash"]).select("id", (-F.col("best.minus_id")).alias("head")).where("id <> head").distinct()
    a = ordered.select("id", F.col("n").alias("n_a"), F.col("tokens").alias("ta"))
    b = ordered.select(F.col("id").alias("head"), F.col("n").alias("n_b"), F.col("tokens").alias("tb"), F.col("central").alias("central_b"))
    found = stored(pairs.join(a, "id").join(b, "head").withColumn("common", overlap("ta", "tb")).where(linked("n_a", "n_b", "common", percent)).select(
        "id", "head", "central_b", F.col("n_a").alias("n"), (F.size("ta") - F.col("common")).alias("s"),
        F.array_except("tb", "ta").alias("minus"), F.array_except("ta", "tb").alias("plus")), "ties")
    heads_only = found.join(found.select(F.col("id").alias("head")).distinct(), "head", "left_anti").where(F.col("s") * 100 <= F.col("n") * SLACK)
    chosen = heads_only.groupBy("id").agg(F.max_by("head", F.struct("central_b", (-F.col("head")).alias("h"))).alias("head"))
    return found.select(F.col("id").alias("src"), F.col("head").alias("dst")), stored(
        heads_only.join(chosen, ["id", "head"]).select("id", "head", "n", "s", "minus", "plus"), "tied")


def need(percent: int) -> Column:
    """What a set asks of the overlap of two heads, times (100 + percent); two sets link only if it covers the sum of both."""
    return F.col("n") * percent - F.col("s") * (100 + percent)


def heads_of(ordered: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Sets that are not tied to another, with the least need and the least overlap that any set of theirs can have."""
    least_overlap = F.ceil((F.col("n") * (percent - SLACK) - F.col("s") * 100) / 100)
    of_members = members.groupBy("head").agg(F.min(need(percent)).alias("need_m"), F.min(least_overlap).alias("least_m"), F.count(F.lit(1)).alias("tied"))
    own = ordered.join(members.select("id"), "id", "left_anti").withColumn("s", F.lit(0))
    return stored(own.join(of_members, own["id"] == of_members["head"], "left").select(
        "id", "n", "tokens", F.least(need(percent), "need_m").alias("need"), F.least(least_overlap, "least_m").alias("least"),
        F.coalesce("tied", F.lit(0)).alias("tied")), "heads")


def block_of(remaining: str | Column) -> Column:
    return F.floor(F.log(F.col(remaining) if isinstance(remaining, str) else remaining) / float(np.log(CLASS))).cast("int")


def size_class(need: Column) -> Column:
    return F.floor(F.log(F.greatest(need, F.lit(1))) / float(np.log(FINE))).cast("int")


def candidates(heads: DataFrame, percent: int) -> DataFrame:
    """Pairs of heads (p, q) that share a prefix shingle at positions that still allow the overlap they need.

    The head that needs less is in the lists. As a pair needs at least twice what that one asks for, an entry after which too few shingles remain is in no
    list: that removes what many unlike texts share, such as the template of a site. A block that is long all the same is parted by what its entries need, and
    a probe looks only at the parts whose need its own remainder can cover.
    """
    rare = F.col("n") - F.size("tokens")  # shingles of no other set come first in the order
    prefix = F.greatest(F.col("n") - F.col("least") + 1 - rare, F.lit(0)).cast("int")
    entries = heads.select("id", "n", "need", "least", rare.alias("rare"), F.posexplode(F.slice("tokens", F.lit(1), prefix)).alias("at", "token")).select(
        "id", "n", "need", "least", "token", (F.col("n") - F.col("rare") - F.col("at")).alias("remaining"))
    listed = entries.where(F.col("remaining") * (100 + percent) >= 2 * F.col("need")).select(
        "token", F.col("id").alias("q"), F.col("need").alias("need_q"), F.col("remaining").alias("r_q"), block_of("remaining").alias("block"))
    long_ = sized(listed.groupBy("token", "block").agg(F.count(F.lit(1)).alias("__n"), F.min("need_q").alias("least_need")).where(F.col("__n") > LONG_BLOCK).drop("__n"))
    # The larger probes: blocks below the overlap that it needs are skipped.
    probes = entries.select("token", F.col("id").alias("p"), F.col("need").alias("need_p"), F.col("remaining").alias("r_p"),
                            F.explode(F.sequence(block_of(F.greatest("least", F.lit(1))) - 1, block_of("n") + 1)).alias("block"))
    most = F.least("need_p", F.col("r_p") * (100 + percent) - F.col("need_p"))  # what an entry may need at most
    parts = F.when(F.col("least_need").isNull(), F.array(F.lit(-1))).when(
        most >= F.col("least_need"), F.sequence(size_class(F.col("least_need")), size_class(most))).otherwise(F.array().cast("array<int>"))
    probes = probes.join(long_, ["token", "block"], "left").withColumn("part", F.explode(parts)).drop("least_need")
    listed = listed.join(long_, ["token", "block"], "left").withColumn("part", F.when(F.col("least_need").isNull(), -1).otherwise(size_class(F.col("need_q")))).drop("least_need")
    less = (F.col("need_q") < F.col("need_p")) | ((F.col("need_q") == F.col("need_p")) & (F.col("q") < F.col("p")))
    enough = F.least("r_p", "r_q") * (100 + percent) >= F.col("need_p") + F.col("need_q")
    return probes.join(listed, ["token", "block", "part"]).where(less & enough).select("p", "q").distinct()


def compared(heads: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs with their exact overlap."""
    p = heads.select(F.col("id").alias("p"), F.col("n").alias("n_p"), F.col("need").alias("need_p"), F.col("tied").alias("tied_p"), F.col("tokens").alias("tp"))
    q = heads.select(F.col("id").alias("q"), F.col("n").alias("n_q"), F.col("need").alias("need_q"), F.col("tied").alias("tied_q"), F.col("tokens").alias("tq"))
    return stored(candidates(heads, percent).join(p, "p").join(q, "q").withColumn("common", overlap("tp", "tq")).drop("tp", "tq")
                  .where(F.col("common") * (100 + percent) >= F.col("need_p") + F.col("need_q")), "compared")


def derived(open_pairs: DataFrame, heads: DataFrame, members: DataFrame, ordered: DataFrame, percent: int) -> DataFrame:
    """Links between sets of two heads that are not linked themselves, from the heads' overlap and the sets' differences."""
    nothing = F.array().cast("array<long>")
    group = members.select("head", "id", "n", "s", "minus", "plus").unionByName(
        heads.select(F.col("id").alias("head"), "id", "n", F.lit(0).alias("s"), nothing.alias("minus"), nothing.alias("plus")))
    x = group.select(F.col("head").alias("p"), F.col("id").alias("x"), F.col("n").alias("n_x"), need(percent).alias("need_x"), F.col("minus").alias("minus_x"), F.col("plus").alias("plus_x"))
    y = group.select(F.col("head").alias("q"), F.col("id").alias("y"), F.col("n").alias("n_y"), need(percent).alias("need_y"), F.col("minus").alias("minus_y"), F.col("plus").alias("plus_y"))
    allowed = F.col("common") * (100 + percent)
    pairs = open_pairs.join(x, "p").where(F.col("need_x") + F.col("need_q") <= allowed).join(y, "q").where(F.col("need_x") + F.col("need_y") <= allowed)
    p = ordered.select(F.col("id").alias("p"), F.col("tokens").alias("tp"))
    t = ordered.select(F.col("id").alias("y"), F.col("tokens").alias("ty"))
    with_y = F.col("common") - overlap("tp", "minus_y") + overlap("tp", "plus_y")      # |p & y|
    both = F.col("with_y") - overlap("minus_x", "ty") + overlap("plus_x", "ty")        # |x & y|
    return pairs.join(p, "p").withColumn("with_y", with_y).drop("tp").join(t, "y").withColumn("common", both).where(
        linked("n_x", "n_y", "common", percent)).select(F.col("x").alias("src"), F.col("y").alias("dst"))


def similar_components(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``."""
    source = text_column(docs, id_col, text_col)
    rows = stored(shared_counts(source, 2 * partitions(docs.sparkSession)), "shingles")
    may_link = (F.col("n_shingles") > 0) & (F.col("shared") * 100 >= F.col("n_shingles") * percent) & F.col("doc_id").isNotNull()
    equal = stored(rows.where(may_link).groupBy("d0", "d1").agg(F.min("doc_id").alias("first")).withColumn("id", F.monotonically_increasing_id()), "equal-sets")
    sets = sets_of(source, equal)
    ordered = ordered_sets(sets, percent)
    ties, members = tied(ordered, sets.select("id", "least"), percent)
    heads = heads_of(ordered, members, percent)
    pairs = compared(heads, percent)
    direct = linked("n_p", "n_q", "common", percent)
    indirect = derived(pairs.where(~direct & (F.col("tied_p") + F.col("tied_q") > 0)), heads, members, ordered, percent)
    links = ties.unionByName(pairs.where(direct).select(F.col("p").alias("src"), F.col("q").alias("dst"))).unionByName(indirect)
    # Texts of one doc_id are one document: its sets are tied to the least of them.
    several = sized(rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("doc_id"))
    standing = rows.where(may_link).join(several, "doc_id", "left_semi").select("doc_id", "d0", "d1").distinct().join(equal, ["d0", "d1"]).select("doc_id", "id")
    links = links.unionByName(standing.join(standing.groupBy("doc_id").agg(F.min("id").alias("dst")), "doc_id").where("id <> dst").select(F.col("id").alias("src"), "dst"))
    grouped = equal.join(components(links), F.col("id") == F.col("node"), "left").withColumn("group", F.coalesce("component", "id"))
    named = grouped.select("d0", "d1", "group").join(grouped.groupBy("group").agg(F.min("first").alias("component")), "group").drop("group")
    keyed = rows.withColumns({c: F.when(may_link, F.col(c)) for c in ("d0", "d1")})
    placed = keyed.join(named, ["d0", "d1"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    # A row of such a doc_id without shingles that others share belongs to the component of its other texts.
    shown = sized(placed.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("least")))
    return placed.join(shown, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("least", "component_id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of each component the document with the smallest doc_id, all columns as they were; rows without doc_id stay.

    A doc_id that stands in several rows stays if one of them is to stay.
    """
    gone = stored(similar_components(docs, percent).groupBy(F.col("doc_id").alias("__id")).agg(F.max("component_id").alias("c")).where("c < __id").select("__id"), "similar")
    few = gone.count() <= SMALL
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col("__id"), "left_anti")


@register("op5_shingle_join")
def op5_shingle_join(spark: SparkSession, root: str) -> DataFrame:
    return similar_components(documents(spark, root))

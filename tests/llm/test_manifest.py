import hashlib
import zlib

from pyspark.sql import functions as F

from assay.llm import manifest
from tests.llm import data


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(doc_id, text, lang, source, n_chars):
    return h("".join(map(enc, (doc_id, source, lang, n_chars, text))))


def tree(digests, width=8):
    """Root of a list of digests, and for each of them the siblings on its way up: (left, right) by level."""
    paths, places, nodes = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(nodes) > 1:
        for path, place in zip(paths, places):
            first = place // width * width
            path.append(("".join(nodes[first:place]), "".join(nodes[place + 1:first + width])))
        nodes = [h("".join(nodes[i:i + width])) for i in range(0, len(nodes), width)]
        places = [p // width for p in places]
    return nodes[0], paths


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def expected(rows, width=8):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r[:5])
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    order = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for g in names}
    trees = {g: tree([leaf(*r) for r in order[g]], width) for g in names}
    root, upper = tree([trees[g][0] for g in names], width)
    out = []
    for g, above in zip(names, upper):
        for r, path in zip(order[g], trees[g][1]):
            path = path + above
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            so_far = leaf(r[0], lowered(r[1]) if changed else r[1], *r[2:])
            for left, right in path:
                so_far = h(left + so_far + right)
            out.append((r[0], leaf(*r), trees[g][0], root, h("".join(a + b for a, b in path)), so_far, so_far == root))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_against_brute_force(spark):
    out = got(manifest.verified(data.frame(spark)))
    assert out == expected(data.rows())
    assert {r[-1] for r in out} == {True, False}


def test_sizes_at_the_borders_of_levels(spark):
    sizes = [1, 2, 7, 8, 9, 63, 64, 65, 512, 520]
    rows = [(1000 * g + i, f"Text {i % 9}", f"l{g}", "s", i) + (None,) * len(data.EXTRA) for g, n in enumerate(sizes) for i in range(n)]
    assert got(manifest.verified(data.frame(spark, rows))) == expected(rows)


def test_one_leaf_is_its_tree(spark):
    rows = [(3, "Text", "en", "s", 4) + (None,) * len(data.EXTRA)]
    out = got(manifest.verified(data.frame(spark, rows)))
    assert out == expected(rows) and out[0][1] == out[0][2] == out[0][3] and out[0][4] == h("")


def test_many_groups_and_another_fan_out(spark):
    rows = [(i, f"Text {i}", f"l{i % 23}" if i % 5 else ("" if i % 2 else None), "s", i) + (None,) * len(data.EXTRA) for i in range(90)]
    assert got(manifest.verified(data.frame(spark, rows), fanout=3)) == expected(rows, 3)


def test_hot_group_is_split_into_ranges(spark, monkeypatch):
    monkeypatch.setattr(manifest, "RANGE_ROWS", 40)
    rows = [(i, f"T {i}", "en" if i % 3 else "de", "s", i) + (None,) * len(data.EXTRA) for i in range(400)]
    rows += rows[:30] + [rows[0]] * 120  # one row a hundred times
    assert got(manifest.verified(data.frame(spark, rows))) == expected(rows)


def test_nodes_cover_their_parents_interval_and_any_change_breaks_the_proof(spark):
    docs = data.frame(spark, data.rows()[:40])
    proofs, groups = manifest.manifest(manifest.leaves_of(docs), ["doc_id"])
    proofs = manifest.stored(proofs, "proofs")
    assert groups.count() == 3
    whole = proofs.select((manifest.folded(F.col("digest"), F.col("path")) == F.col("root")).alias("ok"))
    assert whole.where("NOT ok").count() == 0
    wrong = proofs.select((manifest.folded(F.sha2(F.col("digest").cast("binary"), 256), F.col("path")) == F.col("root")).alias("ok"))
    assert wrong.where("ok").count() == 0


def test_empty_table(spark):
    assert manifest.verified(data.empty(spark)).collect() == []

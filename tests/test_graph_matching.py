"""Components, reachability, near pairs and matching against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from assay.operators import graph, matching


def find_components(edges):
    parent = {}
    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(parent)}


GRAPHS = {
    "path": [(i, i + 1) for i in range(60)],
    "hub": [(500, i) for i in range(80)] + [(600, 601)],
    "loops": [(3, 3), (5, 4), (4, 5), (9, 9)],
    "random": [(a, b) for a, b in (random.Random(3).sample(range(150), 2) for _ in range(110))],
    "empty": [],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    edges = GRAPHS[name]
    got = graph.components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r["node"]: r["component"] for r in got.collect()} == find_components(edges)


def test_network_degrees_clusters(spark):
    tx = spark.createDataFrame([("a", "b", 5.0), ("a", "b", 6.0), ("b", "c", 1.0), ("x", "y", 9.0), (None, "y", 1.0)], "s string, d string, amt double")
    net = graph.network(tx, "s", "d", F.col("amt"))
    assert {tuple(r) for r in net.collect()} == {("a", "b", 2, 11.0), ("b", "c", 1, 1.0), ("x", "y", 1, 9.0)}
    assert {r["node"]: r["degree"] for r in graph.degrees(net).collect()} == {"a": 1, "b": 2, "c": 1, "x": 1, "y": 1}
    got = {(r["component"], r["nodes"], r["weight"], r["suspicious"]) for r in graph.clusters(net, 3, 10).collect()}
    assert got == {("a", 3, 12.0, True), ("x", 2, 9.0, False)}


def test_impact_with_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("z", "y")], "src string, dst string")
    got = graph.impact(edges, spark.createDataFrame([("a",)], "node string"))
    assert {tuple(r) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.mark.parametrize("d", [0, 1, 2])
def test_near_pairs_equal_brute_force(spark, d):
    rnd = random.Random(d)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 7))) for _ in range(80)})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {(r["left_value"], r["right_value"], r["distance"]) for r in matching.near_pairs(df, df, "w", d).collect()}
    assert got == {(a, b, distance(a, b)) for a, b in itertools.product(words, words) if distance(a, b) <= d}


def test_match_entities_equals_brute_force(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(120):
        # a third of the records share one birth date; some fields are missing
        name = rnd.choice(["anna", "ana", "anne", "bert", "berta", "carl", None])
        rows.append((i, name, "1990-01-01" if i % 3 == 0 else f"19{rnd.randrange(60, 64)}-01-01", rnd.choice([None, "111", "222", "333", "444", "555"])))
    df = spark.createDataFrame(rows, "id long, name string, dob string, ssn string")
    got = matching.match_entities(df, "id", {"name": 4, "dob": 3, "ssn": 5}, 8, fuzzy="name", d=1)
    def agree(x, y):
        w = 0
        w += 4 if x[1] is not None and y[1] is not None and distance(x[1], y[1]) <= 1 else 0
        w += 3 if x[2] == y[2] else 0
        w += 5 if x[3] is not None and x[3] == y[3] else 0
        return w >= 8
    edges = [(x[0], y[0]) for x, y in itertools.combinations(rows, 2) if agree(x, y)] + [(r[0], r[0]) for r in rows]
    assert {r["id"]: r["entity"] for r in got.collect()} == find_components(edges)


def test_correct_codes(spark):
    valid = spark.createDataFrame([("E11.9",), ("I10",), ("J18.9",)], "v string")
    codes = spark.createDataFrame([("E11.9",), (" e11.9 ",), ("J18.",), ("E119",), ("INVALID",), ("",), (None,)], "icd string")
    got = {r["icd"]: (r["icd_corrected"], r["icd_outcome"]) for r in matching.correct_codes(codes, "icd", valid, "v").collect()}
    assert got == {"E11.9": ("E11.9", "valid"), " e11.9 ": ("E11.9", "repaired"), "J18.": ("J18.9", "repaired"), "E119": ("E11.9", "repaired"),
                   "INVALID": (None, "unknown"), "": (None, "unknown"), None: (None, "unknown")}


def test_screen(spark):
    people = spark.createDataFrame([(1, "John  Smith"), (2, "JOHN SMITH"), (3, "Jon Smith"), (4, "Mary Jones"), (5, None)], "id long, name string")
    watch = spark.createDataFrame([("JOHN SMITH",), ("Ivan Petrov",)], "listed string")
    got = {(r["id"], r["hit"], r["distance"]) for r in matching.screen(people, "id", "name", watch, "listed").collect()}
    assert got == {(1, "normalised", 0), (2, "exact", 0), (3, "fuzzy", 1)}

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gneiss.operators.hierarchy import canonical_code, course_links, descendants, hierarchy, parent_links

LINKS = "tree string, node string, parent string, declared boolean"


def brute(parents):
    out = {}
    for n in parents:
        path, at = [n], n
        while parents[at] is not None and parents[at] not in path:
            at = parents[at]
            path.append(at)
        out[n] = (None, -1) if parents[at] is not None else (at, len(path) - 1)
    # what hangs under a cycle is cyclic too
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    n = r.randint(1, 60)
    parents = {f"n{i}": (None if r.random() < 0.15 else f"n{r.randrange(n)}") for i in range(n)}
    links = spark.createDataFrame([("t", k, v, True) for k, v in parents.items()], LINKS)
    found = {x["node"]: (x["root"], x["depth"]) for x in hierarchy(links).collect()}
    assert found == brute(parents)


def test_deep_chain_paths_and_descendants(spark):
    n = 300
    links = spark.createDataFrame([("t", f"c{i}", f"c{i - 1}" if i else None, True) for i in range(n)], LINKS)
    found = hierarchy(links)
    last = found.where("node = 'c299'").first()
    assert (last["root"], last["depth"]) == ("c0", 299) and last["path"] == [f"c{i}" for i in range(n)]
    assert descendants(found).where("node = 'c0'").count() == n - 1


def test_star_under_a_hot_node_is_salted(spark):
    rows = [("t", "root", None, True), ("t", "hub", "root", True), *[("t", f"x{i}", "hub", True) for i in range(2000)]]
    found = hierarchy(spark.createDataFrame(rows, LINKS), hot_rows=500)
    assert found.where("depth = 2 and root = 'root'").count() == 2000


def test_self_link_orphan_and_measures(spark):
    rows = [("t", "a", None, 1.0), ("t", "b", "a", 2.0), ("t", "c", "b", 4.0), ("t", "s", "s", 1.0), ("t", "o", "gone", 1.0)]
    links = spark.createDataFrame(rows, "tree string, node string, parent string, w double")
    found = {x["node"]: x for x in hierarchy(links, measures=["w"]).collect()}
    assert found["c"]["sum_w"] == 3.0 and found["a"]["sum_w"] == 0.0
    assert found["s"]["cyclic"] and found["s"]["depth"] == -1 and found["s"]["path"] is None
    assert found["o"]["orphan"] and not found["o"]["cyclic"]


def test_empty_and_nulls(spark):
    edges = spark.createDataFrame([], "doc string, dependent string, prerequisite string, loaded_at timestamp, tree int, node int")
    assert hierarchy(course_links(edges)).count() == 0
    edges = spark.createDataFrame(
        [("d", None, "X1", None, 1, 1), (None, "A1", "B1", None, 1, 1), ("d", "a-1", " ", None, 1, 1), ("d", "B 2", "A1", None, 1, 1), ("d", "b2", "A1", None, 1, 1), ("d", "--", "Q9", None, 1, 1)],
        "doc string, dependent string, prerequisite string, loaded_at timestamp, tree int, node int",
    )
    found = {(x["node"], x["root"], x["depth"]) for x in hierarchy(course_links(edges)).collect()}
    assert found == {("A1", "A1", 0), ("B2", "A1", 1)}


def test_conflicting_rows_have_a_defined_result(spark):
    import datetime as dt

    rows = [("d", "A", "B", dt.datetime(2030, 1, 1)), ("d", "A", "C", dt.datetime(2031, 1, 1)), ("d", "A", None, dt.datetime(2032, 1, 1))]
    e = spark.createDataFrame(rows, "doc string, dependent string, prerequisite string, loaded_at timestamp")
    assert parent_links(e, F.col("doc"), F.col("dependent"), F.col("prerequisite"), F.col("loaded_at")).where("node = 'A'").first()["parent"] == "C"


@pytest.mark.parametrize("raw,code", [(" hjub-0001", "HJUB0001"), ("Abc 12", "ABC12"), ("--", None), (None, None)])
def test_canonical_code(spark, raw, code):
    assert spark.createDataFrame([(raw,)], "c string").select(canonical_code(F.col("c"))).first()[0] == code


def test_segments_of_a_cycle_stay_short_beside_a_long_chain(spark, monkeypatch):
    """Nodes on and under a cycle are settled as soon as their way meets itself, so the chain's
    rounds do not lengthen their segments."""
    from gneiss.operators import hierarchy as H

    longest = []

    def spied(df, *rest):
        out = cut(df, *rest)
        longest.append(out.where("node like 'c%' or node like 'u%'").agg(F.max(F.size("seg"))).first()[0])
        return out

    cut = H.cut
    monkeypatch.setattr(H, "cut", spied)
    chain = [("t", f"n{i}", f"n{i - 1}" if i else None) for i in range(300)]
    cycle = [("t", "c0", "c2"), ("t", "c1", "c0"), ("t", "c2", "c1"), ("t", "u0", "c1"), ("t", "u1", "u0"), ("t", "self", "self")]
    got = {r["node"]: r for r in H.hierarchy(spark.createDataFrame(chain + cycle, "tree string, node string, parent string")).collect()}
    assert all(got[n]["cyclic"] and got[n]["path"] is None and got[n]["depth"] == -1 for n in ("c0", "c1", "c2", "u0", "u1", "self"))
    assert got["n299"]["depth"] == 299 and got["n299"]["path"][:2] == ["n0", "n1"] and not got["n299"]["cyclic"]
    assert max(x or 0 for x in longest) <= 8


def test_released_tables_are_gone(spark):
    import os

    from gneiss import runtime

    runtime.release(spark)
    first = runtime.cut(spark.range(10))
    at = first.inputFiles()[0].removeprefix("file:").replace("///", "/").rsplit("/", 1)[0]
    second = runtime.cut(first.where("id > 3"), instead_of=first)
    assert not os.path.exists(at) and second.count() == 6
    kept = runtime.keep(spark.range(5))
    kept.count()
    assert runtime.release(spark) == 2 and not kept.storageLevel.useMemory

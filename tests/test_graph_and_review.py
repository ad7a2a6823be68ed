import random

import pytest

from lodestone.operators import graph, review

EDGE = "src string, dst string, relation string"


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, "IMPORTS") for a, b in pairs], EDGE)


def test_cycles_and_stats(spark):
    e = edges(spark, ("A", "B"), ("B", "C"), ("C", "A"), ("B", "A"), ("D", "D"))
    assert sorted("".join(r["cycle"]) for r in graph.cycles(e).collect()) == ["AB", "ABC", "D"]
    row = graph.stats(edges(spark, ("A", "B"), ("B", "C"), ("C", "A"))).first()
    assert (row["nodes"], row["edges"], row["density"], row["average_degree"], row["is_dag"]) == (3, 3, 0.5, 2.0, False)
    assert not graph.has_cycle(edges(spark, ("A", "B"), ("B", "C"), ("A", "C"))) and not graph.has_cycle(edges(spark))


def test_paths_and_neighbours(spark):
    e = edges(spark, ("A", "B"), ("B", "C"), ("A", "D"), ("D", "C"))
    got = {r["node"]: r["path"] for r in graph.shortest_paths(e, spark.createDataFrame([("A",), ("Z",)], "source string")).collect()}
    assert got == {"A": ["A"], "B": ["A", "B"], "D": ["A", "D"], "C": ["A", "B", "C"]}
    assert sorted(r["neighbor"] for r in graph.neighbors(e, "A").collect()) == ["B", "D"]
    assert graph.neighbors(e, "A", "sideways").count() == 0


def test_upsert_keeps_last_relation(spark):
    more = spark.createDataFrame([("A", "B", "CALLS")], EDGE)
    assert graph.add_dependencies(edges(spark, ("A", "B"), ("B", "C")), more).where("src = 'A'").first()["relation"] == "CALLS"


def test_architecture(spark):
    one = graph.architecture(graph.counts(edges(spark, ("A", "B"), ("B", "C"), ("A", "C")))).first()
    assert (one["cohesion_score"], one["coupling_ratio"], one["verdict"]) == (0.5, 1.0, "GOOD")
    none = graph.architecture(graph.counts(edges(spark))).first()
    assert (none["cohesion_score"], none["coupling_ratio"], none["architecture_pattern"], none["verdict"]) == (0.0, 0.0, "Unknown", "POOR")


def test_review(spark):
    diffs = spark.createDataFrame([(1, ""), (2, "+x = eval(y)"), (3, None), (4, "+def f(a, self):\n+def f(b):\n+class X: pass")], "pr_id int, diff string")
    got = {r["pr_id"]: r for r in review.review(diffs).collect()}
    assert (got[1]["risk_score"], got[1]["overall_status"], got[1]["security"]["risk_score"]) == ("MEDIUM", "CHANGES_REQUESTED", "LOW")
    assert (got[2]["security"]["status"], got[2]["risk_score"], got[2]["overall_status"]) == ("FAIL", "CRITICAL", "BLOCKED")
    assert got[3]["overall_status"] == "CHANGES_REQUESTED" and len(got[3]["checklist"]) == 4
    assert [(f["name"], f["params"]) for f in got[4]["testing"]["functions_found"]] == [("f", ["a"])]
    good = review.review(diffs.where("pr_id = 1"), edges=edges(spark, ("A", "B"), ("B", "C"), ("A", "C"))).first()
    assert good["overall_status"] == "APPROVED"


def test_far_nodes_and_long_rings(spark):
    ring = edges(spark, *[(f"n{i:02}", f"n{(i + 1) % 12:02}") for i in range(12)], ("n00", "out"), ("in", "n00"))
    row = graph.stats(ring).first()
    assert row["has_circular_deps"] and not row["is_dag"] and row["circular_dependencies"] == [[f"n{i:02}" for i in range(12)]]
    line = edges(spark, *[(f"p{i:02}", f"p{i + 1:02}") for i in range(20)])
    last = graph.shortest_paths(line, spark.createDataFrame([("p00",)], "source string")).where("node = 'p20'").first()
    assert last["hops"] == 20 and graph.stats(line).first()["is_dag"] and graph.stats(edges(spark)).first()["circular_dependencies"] == []


def plain_components(pairs):
    reach = {n: {n} for e in pairs for n in e}
    for _ in reach:
        for a, b in pairs:
            for n in reach:
                if a in reach[n]:
                    reach[n].add(b)
    groups = {frozenset(m for m in reach if m in reach[n] and n in reach[m]) for n in reach}
    return {g for g in groups if len(g) > 1 or (next(iter(g)),) * 2 in pairs}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    draw = random.Random(seed)
    pairs = {(f"n{draw.randint(0, 15):02}", f"n{draw.randint(0, 15):02}") for _ in range(20)}
    got = {}
    for r in graph.components(edges(spark, *pairs)).collect():
        got.setdefault(r["component"], set()).add(r["node"])
    assert {frozenset(g) for g in got.values()} == plain_components(pairs) and all(c == max(g) for c, g in got.items())


def test_dense_component_ends(spark):
    dense = [(f"d{a:02}", f"d{b:02}") for a in range(25) for b in range(25) if a != b]
    row = graph.stats(edges(spark, *dense, ("d00", "out"), ("in", "d00")), list_cycles=False).first()
    assert row["has_circular_deps"] and row["circular_dependencies"] == [sorted({a for a, _ in dense})]


@pytest.mark.parametrize("seed", [3, 4])
def test_shortest_path_from_both_ends(spark, seed, monkeypatch):
    draw = random.Random(seed)
    e = edges(spark, *{(f"n{draw.randint(0, 30):02}", f"n{draw.randint(0, 30):02}") for _ in range(60)})
    whole = {r["node"]: (r["hops"], r["path"]) for r in graph.shortest_paths(e, spark.createDataFrame([("n00",)], "source string")).collect()}
    for target in ("n00", "n07", "n19", "absent"):
        found = graph.shortest_path(e, "n00", target).collect()
        assert [(r["hops"], r["path"]) for r in found] == ([whole[target]] if target in whole else [])
    made = []
    monkeypatch.setattr(graph, "cut", lambda df, real=graph.cut: made.append(1) or real(df))
    line = edges(spark, *[(f"p{i:02}", f"p{i + 1:02}") for i in range(30)], *[(f"p{i:02}", f"x{i:02}") for i in range(30)])
    assert graph.shortest_path(line, "p10", "p13").first()["path"] == ["p10", "p11", "p12", "p13"] and len(made) <= 6


def test_dependency_map(spark):
    rows = [("a.py", "b", 1), ("b.py", "a", 1), ("b.py", "os", 2)]
    imports = spark.createDataFrame([(p, m, [m], n) for p, m, n in rows], "path string, module string, names array<string>, line int")
    row = graph.dependency_map(imports).first()
    assert (row["total_dependencies"], row["internal_dependencies"], row["external_dependencies"]) == (3, 2, 1)
    assert row["circular_dependencies"] == [["a", "b"]] and row["has_circular_deps"] and len(row["edges"]) == 3


def test_agents_say_why(spark):
    diffs = spark.createDataFrame([(1, "+x = eval(y)\n+time.sleep(1)"), (2, "+x = 1")], "pr_id int, diff string")
    got = {r["pr_id"]: r for r in review.review(diffs).collect()}
    assert got[1]["security"]["recommendation"] != got[2]["security"]["recommendation"] and got[1]["security"]["findings"][0]["description"]
    issue = got[1]["performance"]["issues"][0]
    assert issue["issue"] == "Blocking sleep" and issue["description"] and issue["suggestion"] and got[2]["performance"]["memory_usage"] == "OPTIMAL"

"""Module graphs as edge tables (src, dst, relation): building, neighbours, paths, cycles, metrics, review verdicts."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.lineage import cut
from lodestone.functions.text import module_strict


def add_dependencies(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Both edge tables as one, unique in (src, dst); where a pair is in both, the later relation holds."""
    rows = edges.select("src", "dst", "relation", F.lit(0).alias("age")).unionByName(more.select("src", "dst", "relation", F.lit(1).alias("age")))
    return rows.groupBy("src", "dst").agg(F.max_by("relation", "age").alias("relation"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def neighbors(edges: DataFrame, node: str, direction: str = "out") -> DataFrame:
    """Neighbours of one node, by name; none for unknown nodes or directions."""
    if direction == "out":
        found = edges.where(F.col("src") == node).select(F.col("dst").alias("neighbor"))
    elif direction == "in":
        found = edges.where(F.col("dst") == node).select(F.col("src").alias("neighbor"))
    else:
        found = edges.where(F.lit(False)).select(F.col("dst").alias("neighbor"))
    return found.distinct()


def shortest_paths(edges: DataFrame, sources: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(source, node, hops, path) of every node that each source reaches (within max_hops, if given): breadth-first, one
    join a hop until none is new, the alphabetically first path among equals. A visited pair is never extended again."""
    step = cut(edges.select("src", "dst").distinct())
    seen = front = sources.where(F.col("source").isNotNull()).distinct().join(nodes(edges), F.col("source") == F.col("node"), "left_semi").select("source", F.col("source").alias("node"), F.lit(0).alias("hops"), F.array("source").alias("path"))
    for hop in itertools.count(1) if max_hops is None else range(1, max_hops + 1):
        reached = (
            front.join(step, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
            .groupBy("source", "node").agg(F.min("path").alias("path"))
            .join(seen.select("source", "node"), ["source", "node"], "left_anti")
            .select("source", "node", F.lit(hop).alias("hops"), "path")
        )
        front = cut(reached)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def cyclic_part(edges: DataFrame) -> DataFrame:
    """(src, dst) without the edges that no cycle can hold: those from nodes that none leads to, and to nodes that lead
    nowhere, are peeled off until none goes."""
    left = cut(edges.select("src", "dst").distinct())
    size = left.count()
    while size:
        led = left.join(left.select(F.col("dst").alias("d")).distinct(), F.col("src") == F.col("d"), "left_semi")
        left = cut(led.join(led.select(F.col("src").alias("s")).distinct(), F.col("dst") == F.col("s"), "left_semi"))
        was, size = size, left.count()
        if size == was:
            break
    return left


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the strongly connected components that hold a cycle, each named by its greatest node.

    What no cycle can hold is peeled off. Of the rest each node takes the greatest node that reaches it as its colour,
    a join a step until none changes; from the nodes that are their own colour, what leads to them within the colour is
    their component. These go, and the rest is peeled and coloured again."""
    left, found = cyclic_part(edges), None
    loops = left.where("src = dst").select(F.col("src").alias("loop"))
    while not left.isEmpty():
        colour, open_ = cut(nodes(left).select("node", F.col("node").alias("colour"))), True
        while open_:
            passed = left.join(colour, F.col("src") == F.col("node")).groupBy("dst").agg(F.max("colour").alias("passed"))
            later = cut(colour.join(passed, F.col("node") == F.col("dst"), "left").select("node", F.greatest("colour", F.coalesce("passed", "colour")).alias("colour"), (F.col("passed") > F.col("colour")).alias("grew")))
            colour, open_ = later.select("node", "colour"), not later.where("grew").isEmpty()
        of = lambda end: colour.select(F.col("node").alias(end), F.col("colour").alias(f"{end}_colour"))
        within = cut(left.join(of("src"), "src").join(of("dst"), "dst").where("src_colour = dst_colour").select("src", "dst", F.col("src_colour").alias("colour")))
        front = member = cut(colour.where("node = colour"))
        while not front.isEmpty():
            reached = within.join(front.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"), "colour").distinct()
            front = cut(reached.join(member, "node", "left_anti"))
            member = cut(member.unionByName(front))
        found = member if found is None else found.unionByName(member)
        gone = member.select("node")
        left = cyclic_part(left.join(gone, F.col("src") == F.col("node"), "left_anti").join(gone, F.col("dst") == F.col("node"), "left_anti"))
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    size = found.groupBy("colour").agg(F.count(F.lit(1)).alias("size"))
    whole = found.join(size, "colour").join(loops, F.col("node") == F.col("loop"), "left").where("size > 1 OR loop IS NOT NULL")
    return cut(whole.select("node", F.col("colour").alias("component")))


def _inner(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(src, dst) of the edges within one component."""
    of = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"{end}_part"))
    return cut(edges.select("src", "dst").distinct().join(of("src"), "src").join(of("dst"), "dst").where("src_part = dst_part").select("src", "dst"))


def cycles(edges: DataFrame, max_length: int | None = None) -> DataFrame:
    """(length, cycle) of all simple cycles (up to max_length, if given), self-loops included; each starts at its smallest
    node.

    Walks start at each node and only visit greater ones of its strongly connected component, none twice, so a cycle is
    found once and the walks come to an end. A dense component of n nodes has more than 2 ** n cycles: `components` says
    which these are without listing cycles."""
    step = _inner(edges, components(edges))
    walks = step.where("dst >= src").select(F.col("src").alias("start"), F.col("dst").alias("at"), F.array("src").alias("path"))
    found = None
    for length in itertools.count(1):
        closed = walks.where("at = start").select(F.lit(length).alias("length"), F.col("path").alias("cycle"))
        found = closed if found is None else found.unionByName(closed)
        if length == max_length:
            break
        open_ = walks.where((F.col("at") > F.col("start")) & ~F.array_contains("path", F.col("at")))
        walks = cut(open_.join(step, F.col("at") == F.col("src")).where("dst >= start").select("start", F.col("dst").alias("at"), F.concat("path", F.array(F.col("src"))).alias("path")))
        if walks.isEmpty():
            break
    return found


def shortest_path(edges: DataFrame, source, target) -> DataFrame:
    """(hops, path) of the shortest path between two nodes, the alphabetically first among equals; no row where there is
    none. One frontier goes out from each end, the smaller first, a join a step, until they meet; nodes beyond are never
    visited. Each visited node keeps its own first path, so what both ends know of a meeting node is joined."""
    step = cut(edges.select("src", "dst").distinct())
    known = nodes(step)
    start = lambda n: cut(known.where(F.col("node") == n).select("node", F.array("node").alias("path")))
    sides = {True: [start(source)], False: [start(target)]}  # by the side that goes forward; a table for each step
    seen = {side: levels[0] for side, levels in sides.items()}
    size = {side: levels[0].count() for side, levels in sides.items()}
    none = step.select(F.lit(0).alias("hops"), F.array("src").alias("path")).limit(0)
    while all(size.values()):
        ahead, behind = sides[True][-1], sides[False][-1]
        meet = ahead.join(behind.select("node", F.col("path").alias("rest")), "node")
        both = meet.select(F.concat("path", F.slice("rest", 2, F.greatest(F.size("rest") - 1, F.lit(0)))).alias("path"))
        best = both.agg(F.min("path").alias("path")).where("path IS NOT NULL")
        if not meet.isEmpty():
            return best.select((F.size("path") - 1).alias("hops"), "path")
        side = size[True] <= size[False]
        here, there = ("src", "dst") if side else ("dst", "src")
        path = F.concat("path", F.array(there)) if side else F.concat(F.array(there), F.col("path"))
        reached = sides[side][-1].join(step, F.col("node") == F.col(here)).select(F.col(there).alias("node"), path.alias("path")).groupBy("node").agg(F.min("path").alias("path"))
        front = cut(reached.join(seen[side].select("node"), "node", "left_anti"))
        sides[side].append(front)
        seen[side], size[side] = seen[side].unionByName(front), front.count()
    return none


def counts(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges."""
    n = nodes(edges).agg(F.count(F.lit(1)).alias("nodes"))
    return n.join(F.broadcast(edges.select("src", "dst").distinct().agg(F.count(F.lit(1)).alias("edges"))), F.lit(True))


def metrics(counted: DataFrame) -> DataFrame:
    """Adds density and average_degree to nodes and edges."""
    n, m = F.col("nodes"), F.col("edges")
    return counted.withColumns(
        {
            "density": F.when((m == 0) | (n <= 1), 0.0).otherwise(F.round(m / (n * (n - 1)), 6)),
            "average_degree": F.when(n == 0, 0.0).otherwise(F.round(2 * m / n, 6)),
        }
    )


def has_cycle(edges: DataFrame) -> bool:
    """Whether any cycle exists: whether peeling leaves anything."""
    return not cyclic_part(edges).isEmpty()


def stats(edges: DataFrame, list_cycles: bool = True) -> DataFrame:
    """One row: nodes, edges, is_dag, density, average_degree, circular_dependencies, has_circular_deps. Whether there is
    a cycle is known without listing any. Without list_cycles the circular dependencies are the components that hold
    cycles, each as its nodes, which a dense graph has few of."""
    if list_cycles:
        groups = cycles(edges).select("cycle")
    else:
        groups = components(edges).groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("cycle")).select("cycle")
    loops = groups.agg(F.array_sort(F.collect_list("cycle")).alias("circular_dependencies"))
    some = F.lit(has_cycle(edges))
    return loops.join(F.broadcast(metrics(counts(edges))), F.lit(True)).withColumns({"is_dag": ~some, "has_circular_deps": some})  # one row and one row


def architecture(counted: DataFrame) -> DataFrame:
    """Adds the architecture review of graphs with nodes and edges columns: pattern, cohesion, coupling, verdict."""
    n, m = F.col("nodes"), F.col("edges")
    rows = counted.withColumns(
        {
            "cohesion_score": F.round(m / F.when(n > 1, n * (n - 1)).otherwise(1), 4),
            "coupling_ratio": F.when(n > 0, F.round(m / n, 2)).otherwise(0.0),
            "architecture_pattern": F.when(n == 0, "Unknown").when((n <= 10) & (m <= 15), "4-Part Modular Enterprise Layering").when(m / n > 4, "Highly Connected / Potential Monolith").otherwise("Modular Layered Architecture"),
        }
    )
    rows = rows.withColumn("coupling_issue_detected", F.col("coupling_ratio") > 5)
    fine = ~F.col("coupling_issue_detected")
    verdict = F.when((F.col("cohesion_score") >= 0.8) & fine, "EXCELLENT").when((F.col("cohesion_score") >= 0.5) & fine, "GOOD").when(~fine, "WARN").otherwise("POOR")
    return rows.withColumn("verdict", verdict)


def with_prefix(modules: DataFrame, prefixes: DataFrame, column: str = "dst") -> DataFrame:
    """The distinct values of a column that start with one of the prefixes (prefix), however many there are. A value's
    beginnings of the lengths that prefixes have, and no others, are looked up among them, so the join is by equality."""
    known = prefixes.where("prefix IS NOT NULL").distinct()
    lengths = known.agg(F.array_sort(F.collect_set(F.length("prefix"))).alias("lengths"))  # one row: as many as names have lengths
    names = modules.select(column).where(F.col(column).isNotNull()).distinct().join(F.broadcast(lengths), F.lit(True))
    cuts = F.transform(F.filter("lengths", lambda n: n <= F.length(column)), lambda n: F.substring(F.col(column), F.lit(1), n))
    return names.select(column, F.explode(cuts).alias("prefix")).join(known, "prefix", "left_semi").select(column).distinct()


def dependency_edges(imports: DataFrame, file: str = "path", prefix: str | DataFrame | None = None) -> DataFrame:
    """Edges of imports (file, module, names, line): source module by path, target module, and whether that is inside
    the analysed files (or starts with `prefix`, or one of a table of them). Imports without a module are none."""
    rows = imports.where("module IS NOT NULL").select(F.col(file).alias("source_file"), module_strict(F.col(file)).alias("src"), F.col("module").alias("dst"), "names", "line")
    if isinstance(prefix, str):
        return rows.withColumn("is_internal", F.startswith("dst", F.lit(prefix)))
    if prefix is not None:
        own = with_prefix(rows, prefix).withColumnRenamed("dst", "own")
    else:
        own = imports.select(module_strict(F.col(file)).alias("own")).where("own IS NOT NULL").distinct()
    return rows.join(own, F.col("dst") == F.col("own"), "left").withColumn("is_internal", F.col("own").isNotNull()).drop("own")


def dependency_summary(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count(F.lit(1)).alias("total_dependencies"), F.count_if("is_internal").alias("internal_dependencies"), F.count_if(~F.col("is_internal")).alias("external_dependencies"))


def import_cycles(edges: DataFrame) -> DataFrame:
    """(length, cycle) of the cycles of modules that import each other, from dependency edges: internal ones, by module
    names on both sides."""
    return cycles(edges.where("is_internal AND src IS NOT NULL").select("src", "dst"))


def dependency_map(imports: DataFrame, file: str = "path", prefix: str | None = None) -> DataFrame:
    """One row: total, internal and external dependencies, circular_dependencies, has_circular_deps and the edges (source
    file, target module, names, line), in order."""
    edges = cut(dependency_edges(imports, file, prefix))
    rows = edges.agg(F.array_sort(F.collect_list(F.struct("source_file", "line", F.col("dst").alias("target_module"), "names", "is_internal"))).alias("edges"))
    loops = import_cycles(edges).agg(F.array_sort(F.collect_list("cycle")).alias("circular_dependencies"))
    return rows.join(F.broadcast(dependency_summary(edges)), F.lit(True)).join(loops, F.lit(True)).withColumn("has_circular_deps", F.size("circular_dependencies") > 0)  # one row each


def upsert_edges(table: DataFrame, new: DataFrame) -> DataFrame:
    """The stored table after new edges: one row for each (src, dst, relation)."""
    return table.unionByName(new.select(*table.columns)).dropDuplicates(["src", "dst", "relation"])



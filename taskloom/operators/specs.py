"""Checks of workflow definitions before they start: of one on the driver, and of a table of them, as rows of faults."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.steps import Steps


@dataclass(frozen=True)
class Node:
    name: str
    node_id: str | None = None
    depends_on: tuple[int, ...] = ()
    results_from: dict[str, int] = field(default_factory=dict)
    join: str = "all"
    min_success: int | None = None


@dataclass(frozen=True)
class Spec:
    name: str
    nodes: tuple[Node, ...]
    output: int | None = None
    cases: dict[str, tuple[int, ...]] = field(default_factory=dict)


def problems(spec: Spec) -> list[str]:
    """All that is wrong with a definition; nothing means that it can start."""
    out, n = [], len(spec.nodes)
    there = lambda i: 0 <= i < n
    if not spec.name:
        out.append("the workflow has no name")
    if not n:
        return [*out, "the workflow has no node"]
    ids = [x.node_id for x in spec.nodes if x.node_id is not None]
    out += [f"node id {i} is used twice" for i in sorted({i for i in ids if ids.count(i) > 1})]
    for i, x in enumerate(spec.nodes):
        if not x.name:
            out.append(f"node {i} has no task")
        out += [f"node {i} depends on {d}, which isn't there" for d in x.depends_on if not there(d)]
        if i in x.depends_on:
            out.append(f"node {i} depends on itself")
        out += [f"node {i} takes the result of {d}, on which it doesn't depend" for d in x.results_from.values() if d not in x.depends_on]
        if x.join not in ("all", "any", "quorum"):
            out.append(f"node {i} joins in an unknown way")
        if x.join == "quorum" and not 1 <= (x.min_success or 0) <= len(x.depends_on):
            out.append(f"node {i} needs a quorum of 1 to {len(x.depends_on)}")
        if x.join != "quorum" and x.min_success is not None:
            out.append(f"node {i} has a quorum but doesn't join by one")
    if all(x.depends_on for x in spec.nodes):
        out.append("no node can begin")
    if circle(spec):
        out.append("nodes depend on each other in a circle")
    if spec.output is not None and not there(spec.output):
        out.append("the output node isn't there")
    for name, need in spec.cases.items():
        if not need or not all(map(there, need)):
            out.append(f"case {name} needs nodes that are there")
    return out


def circle(spec: Spec) -> bool:
    """Takes away nodes without dependencies until none is left, or none can go."""
    left = {i: {d for d in x.depends_on if 0 <= d < len(spec.nodes)} for i, x in enumerate(spec.nodes)}
    while free := [i for i, deps in left.items() if not deps]:
        for i in free:
            del left[i]
        for deps in left.values():
            deps.difference_update(free)
    return bool(left)


def built(make: Callable[..., Spec], **parameters) -> Spec:
    """A definition from parameters, refused if anything is wrong with it."""
    spec = make(**parameters)
    if found := problems(spec):
        raise ValueError("; ".join(found))
    return spec


@dataclass(frozen=True)
class Part:
    """A part of a parameterised definition: one node, or as many as a column of the parameters says, each of which depends
    on all nodes of the parts before it (after), or with `each` on the node of the same number."""

    name: str
    after: tuple[str, ...] = ()
    times: str | None = None
    each: bool = False


def from_parameters(parameters: DataFrame, parts: list[Part], key: str = "workflow_id") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a definition for each row of parameters: key, task_index, node_id; key, task_index, dep.

    Indexes go by the order of parts, then by number; a part of no nodes (0 or null) is left out, and so are dependencies on it.
    """
    known = {p.name for p in parts}
    if len(known) != len(parts) or any(a not in known for p in parts for a in p.after):
        raise ValueError("parts need names of their own, and come after known ones")
    size = lambda p: F.greatest(F.coalesce(F.col(p.times).cast("int"), F.lit(0)), F.lit(0)) if p.times else F.lit(1)
    first, starts = F.lit(0), {}
    for p in parts:
        starts[p.name], first = first, first + size(p)
    numbers = lambda p: F.filter(F.sequence(F.lit(0), size(p)), lambda n: n < size(p))
    by = {p.name: p for p in parts}
    node = lambda p: F.transform(numbers(p), lambda n: F.struct((starts[p.name] + n).alias("task_index"), F.concat(F.lit(p.name), F.concat(F.lit("-"), n.cast("string")) if p.times else F.lit("")).alias("node_id")))

    def links(p: Part, a: str) -> Column:
        q = by[a]
        pair = lambda n, m: F.struct((starts[p.name] + n).alias("task_index"), (starts[a] + m).alias("dep"))
        if p.each:
            return F.transform(F.filter(numbers(p), lambda n: n < size(q)), lambda n: pair(n, n))
        return F.flatten(F.transform(numbers(p), lambda n: F.transform(numbers(q), lambda m: pair(n, m))))

    rows = parameters.select(key, F.explode(F.concat(*map(node, parts))).alias("x")).select(key, "x.*")
    every = [links(p, a) for p in parts for a in p.after]
    edges = parameters.select(key, F.explode(F.concat(*every)).alias("x")).select(key, "x.*")
    return rows, edges


def as_rows(spec: Spec, like: DataFrame) -> DataFrame:
    """The definition's edges as a DataFrame (task_index, dep)."""
    return like.sparkSession.createDataFrame([(i, d) for i, x in enumerate(spec.nodes) for d in x.depends_on], "task_index int, dep long")


def circles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(workflow_id) of definitions whose nodes depend on each other in a circle.

    Kahn's peeling: nodes without open dependencies go, and so do those that nothing open depends on; what is left when
    none goes lies on a circle or between two. Each round peels twice from either end and is a written table. nodes: workflow_id,
    task_index; edges: the same and dep. Dependencies that aren't there don't count. Null keys and repeated rows do no harm.
    A circle goes up and down in the order of indexes (or stays where it is), so only definitions whose dependencies do
    both are peeled.
    """
    steps = Steps(edges.sparkSession)
    keys = ["workflow_id", "task_index"]
    links = edges.select("workflow_id", F.col("task_index").cast("long").alias("task_index"), F.col("dep").cast("long").alias("dep"))
    both = links.groupBy("workflow_id").agg(F.bool_or(F.col("dep") >= F.col("task_index")).alias("up"), F.bool_or(F.col("dep") <= F.col("task_index")).alias("down")).where("up and down").select("workflow_id")
    there = nodes.join(both, "workflow_id", "left_semi").select("workflow_id", F.col("task_index").cast("long").alias("dep"))
    left = steps.put(links.join(both, "workflow_id", "left_semi").distinct().join(there, ["workflow_id", "dep"], "left_semi"))
    n = left.count()
    while n:
        peeled = left
        for _ in range(2):
            open_ = peeled.select("workflow_id", F.col("task_index").alias("dep")).distinct()
            peeled = peeled.join(open_, ["workflow_id", "dep"], "left_semi")
            used = peeled.select("workflow_id", F.col("dep").alias("task_index")).distinct()
            peeled = peeled.join(used, keys, "left_semi")
        at = steps.write(peeled.select("workflow_id", "task_index", "dep"))
        left = steps.read(at, like=links)
        steps.keep(at)
        before, n = n, left.count()
        if n == before:
            break
    return left.select("workflow_id").distinct()


#: What a node id may hold, and the most characters.
NODE_ID, LONGEST_ID = r"^[A-Za-z0-9_\-:.]+$", 128


def spec_faults(workflows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(workflow_id, task_index, fault): all that is wrong with the definitions of a table, task_index null where it is the whole one.

    workflows: id, name, output_index; nodes: workflow_id, task_index, node_id, join_type, min_success; edges: workflow_id,
    task_index, dep. Faults: NAME, EMPTY, NO_ROOT, CIRCLE, OUTPUT; of nodes ID_INVALID, ID_TWICE (all but the first that
    has the id), JOIN, QUORUM; of dependencies RANGE, SELF. No rows mean that all can start.
    """
    steps = Steps(workflows.sparkSession)  # what is read again and again is written once
    ids = steps.put(workflows.select(F.col("id").alias("workflow_id"), "name", F.col("output_index").cast("long").alias("output_index")))
    own = nodes.select("workflow_id", F.col("task_index").cast("long").alias("task_index"), "node_id", "join_type", F.col("min_success").cast("long").alias("min_success")).join(ids.select("workflow_id"), "workflow_id", "left_semi")
    links = edges.select("workflow_id", F.col("task_index").cast("long").alias("task_index"), F.col("dep").cast("long").alias("dep")).distinct().join(ids.select("workflow_id"), "workflow_id", "left_semi")
    links = steps.put(links)
    deps = links.groupBy("workflow_id", "task_index").agg(F.count("*").alias("deps"))
    counted = own = steps.put(own.join(deps, ["workflow_id", "task_index"], "left").withColumn("deps", F.coalesce("deps", F.lit(0))))
    sizes = counted.groupBy("workflow_id").agg(F.count("*").alias("n"), F.count_if(F.col("deps") == 0).alias("roots"))
    whole = ids.join(sizes, "workflow_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    fault = lambda name, when: F.when(when, name)
    of_all = F.array(
        fault("NAME", F.coalesce("name", F.lit("")) == ""), fault("EMPTY", F.col("n") == 0), fault("NO_ROOT", (F.col("n") > 0) & (F.col("roots") == 0)),
        fault("OUTPUT", (F.col("output_index") < 0) | (F.col("output_index") >= F.col("n"))))
    quorum, least = F.col("join_type") == "quorum", F.col("min_success")
    of_node = F.array(
        fault("ID_INVALID", ~F.col("node_id").rlike(NODE_ID) | (F.length("node_id") > LONGEST_ID)),
        fault("JOIN", ~F.coalesce(F.col("join_type").isin("all", "any", "quorum"), F.lit(False))),
        fault("QUORUM", F.when(quorum, F.coalesce((least < 1) | (least > F.col("deps")), F.lit(True))).otherwise(least.isNotNull())))
    first = own.where("node_id is not null").groupBy("workflow_id", "node_id").agg(F.min("task_index").alias("first"), F.count("*").alias("n")).where("n > 1")
    twice = own.join(first, ["workflow_id", "node_id"]).where("task_index > first")
    of_link = F.array(fault("RANGE", (F.col("dep") < 0) | (F.col("dep") >= F.col("n"))), fault("SELF", F.col("dep") == F.col("task_index")))
    listed = lambda rows, at, faults: rows.select("workflow_id", at.cast("long").alias("task_index"), F.explode(F.array_compact(faults)).alias("fault"))
    none = F.lit(None)
    return (
        listed(whole, none, of_all)
        .unionByName(listed(counted, F.col("task_index"), of_node))
        .unionByName(twice.select("workflow_id", "task_index", F.lit("ID_TWICE").alias("fault")))
        .unionByName(listed(links.join(sizes, "workflow_id"), F.col("task_index"), of_link))
        .unionByName(circles(own, links).select("workflow_id", none.cast("long").alias("task_index"), F.lit("CIRCLE").alias("fault"))))

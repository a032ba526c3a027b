"""Graphs and trees, all of them at once, as loops of joins over frontiers."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The folder for intermediate data that spark.checkpoint.dir names; an error if it names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint()


#: Removes the files of a query's shuffles when it ends.
_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """A Parquet table in the shared folder: lineage is cut as by a checkpoint, in a fraction of its bytes, and the shuffles that made it are removed."""
    spark, folder = df.sparkSession, f"{shared(df.sparkSession)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_SWEEP, None)
    spark.conf.set(_SWEEP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.unset(_SWEEP) if before is None else spark.conf.set(_SWEEP, before)
    return spark.read.schema(df.schema).parquet(folder)


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage: stored(), or a checkpoint where Parquet has no type or name for a column."""
    names = [c.lower() for c in df.columns]
    return kept(df) if "void" in df.schema.simpleString() or len(set(names)) < len(names) else stored(df)


#: Rows of one key that a task may join with the key's row.
HOT = 100_000


def join_hot(rows: DataFrame, few: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """rows joined with few (a row for each key), where one key may have a large share of all rows.

    Keys of more than HOT rows are counted and broadcast, a row for every HOT rows at most. Their
    rows are dealt by the hash of the column `by`; their rows in few are repeated for each share.
    """
    shares = rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > HOT).where(F.col(key).isNotNull())
    shares = F.broadcast(shares.select(key, F.ceil(F.col("__n") / HOT).cast("int").alias("__shares")))
    number = F.coalesce("__shares", F.lit(1))
    dealt = rows.join(shares, key, "left").withColumn("__share", F.pmod(F.xxhash64(by), number).cast("int")).drop("__shares")
    repeated = few.join(shares, key, "left").withColumn("__share", F.explode(F.sequence(F.lit(0), number - 1))).drop("__shares")
    return dealt.join(repeated, [key, "__share"], how).drop("__share")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("src").alias("node")), "node", "left_anti")


def _grown(seen: DataFrame | None, found: DataFrame, rounds: int) -> DataFrame:
    """What was seen so far and what a round found; every so many rounds one table again, so that plans stay small."""
    both = found if seen is None else seen.unionByName(found)
    return cut(both) if rounds % 16 == 0 else both


def shuffled(df: DataFrame) -> DataFrame:
    """The side of a round's join that is never broadcast: rounds of small tables would add up in the driver."""
    return df.hint("merge")


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): longest way from a root; nodes on or behind a cycle have no row.

    A node is free once all its predecessors are. Each round counts, of the nodes that some
    predecessor was freed for, how many were so far; only these nodes are touched, so all
    rounds together read each edge once.
    """
    ways = cut(edges.select("src", "dst").distinct())
    wanted = cut(ways.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("wanted")))
    free = cut(nodes.select("node").distinct().join(shuffled(wanted.select("node")), "node", "left_anti").withColumn("level", F.lit(0)))
    done, waiting, level = free, None, 0
    while True:
        level += 1
        told = free.join(shuffled(ways), F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))
        told = told if waiting is None else told.unionByName(waiting).groupBy("node").agg(F.sum("n").alias("n"))
        touched = cut(told.join(shuffled(wanted), "node"))
        free = touched.where("n = wanted").select("node", F.lit(level).alias("level"))
        if free.isEmpty():
            return done.join(shuffled(nodes.select("node")), "node", "left_semi")
        done, waiting = _grown(done, free, level), touched.where("n < wanted").select("node", "n")


def is_acyclic(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: are all nodes peeled, and how many are left on or behind a cycle."""
    peeled = topological_levels(nodes, edges).select("node").withColumn("peeled", F.lit(1))
    return nodes.join(shuffled(peeled), "node", "left").agg((F.count_if(F.col("peeled").isNull()) == 0).alias("acyclic"), F.count_if(F.col("peeled").isNull()).alias("left_over"))


def ancestors(edges: DataFrame, start: DataFrame, forward: bool = False) -> DataFrame:
    """(start, node, hops): every node before (or after) a start node, once, by the fewest hops.

    Cycles end; a start isn't its own ancestor.
    """
    step = edges.select(F.col("src").alias("at"), F.col("dst").alias("node")) if forward else edges.select(F.col("dst").alias("at"), F.col("src").alias("node"))
    return _pairs(step.withColumns({"open": F.lit(True), "shown": F.lit(True)}), start)


def _pairs(ways: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """(start, node, hops) over ways (at, node, open, shown), from parts of the starts; a part that has too many ways is walked by rounds."""
    from .subgraphs import walked_pairs  # needs this module

    ways = stored(ways.where("at IS NOT NULL AND node IS NOT NULL").distinct())
    pairs, left = walked_pairs(ways, start.select(F.col("node").alias("start")).where("start IS NOT NULL").distinct(), most)
    return pairs if left is None else pairs.unionByName(_rounds_of_pairs(ways, left, most))


def _rounds_of_pairs(ways: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(start, node, hops) over ways (at, node, open, shown) by rounds. Semi-naive: only pairs found last are joined with the ways."""
    frontier, seen, hops = cut(starts.select("start", F.col("start").alias("at"))), None, 0
    while most is None or hops < most:
        hops += 1
        found = frontier.join(shuffled(ways), "at").select("start", "node", "open", "shown").where(F.col("node") != F.col("start")).distinct()
        found = found if seen is None else found.join(shuffled(seen.select("start", "node")), ["start", "node"], "left_anti")
        found = cut(found.withColumn("hops", F.lit(hops)))
        if found.isEmpty():
            break
        seen = _grown(seen, found, hops)
        frontier = found.where("open").select("start", F.col("node").alias("at"))
    return (found if seen is None else seen).where("shown").select("start", "node", "hops")


def _plain(edges: DataFrame) -> DataFrame:
    """The nodes of edges, all of one kind, for walks over sets."""
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct().withColumn("kind", F.lit("task"))


def target_subgraph(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges among the targets and all their ancestors."""
    inside = reached(_plain(edges), edges, targets, forward=False).unionByName(targets.select("node")).distinct()
    return edges.join(inside.withColumnRenamed("node", "src"), "src", "left_semi").join(inside.withColumnRenamed("node", "dst"), "dst", "left_semi")


def ready_atoms(nodes: DataFrame, edges: DataFrame, states: DataFrame) -> DataFrame:
    """PENDING nodes whose direct and farther predecessors are all SUCCESS.

    What isn't SUCCESS blocks all that it reaches: a walk over sets of nodes, no closure.
    """
    known = nodes.select("node").join(states.select("node", "state"), "node")
    kinds = nodes.select("node", F.lit("task").alias("kind"))
    blocked = reached(kinds, edges, known.where(~F.coalesce(F.col("state") == "SUCCESS", F.lit(False))))
    return known.where("state = 'PENDING'").join(blocked, "node", "left_anti").select("node")


def reset_subgraph(edges: DataFrame, states: DataFrame, starts: DataFrame, state: str = "PENDING", intention: str = "EXECUTE") -> DataFrame:
    """States with all descendants of the starts set; intention REVERT isn't changed to RETRY."""
    below = reached(_plain(edges), edges, starts).join(starts.select("node"), "node", "left_anti").withColumn("hit", F.lit(True))
    kept = F.lit(intention == "RETRY") & (F.col("intention") == "REVERT")
    change = F.col("hit").isNotNull() & ~kept
    return states.join(below, "node", "left").select("node", F.when(change, state).otherwise(F.col("state")).alias("state"), F.when(change, intention).otherwise(F.col("intention")).alias("intention"))


def _rounds(tree: DataFrame) -> int:
    """Doubling rounds that are enough for a tree of so many nodes; after more of them there is a cycle."""
    return tree.count().bit_length() + 1


def _cycle(left: int) -> None:
    if left < 0:
        raise ValueError("the parents of some nodes make a cycle")


def tree_paths(tree: DataFrame) -> DataFrame:
    """(node, ancestor, distance): all ancestor pairs, by doubling: rounds go with the log of the depth. A cycle is an error."""
    pairs = cut(tree.where("parent IS NOT NULL").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")))
    reach, left = 1, _rounds(tree)
    while True:
        left -= 1
        _cycle(left)
        far = pairs.where(F.col("distance") == reach)
        more = far.select("node", F.col("ancestor").alias("via")).join(pairs.select(F.col("node").alias("via"), "ancestor", F.col("distance").alias("d")), "via")
        more = cut(more.select("node", "ancestor", (F.col("d") + reach).alias("distance")))
        if more.isEmpty():
            return pairs
        pairs, reach = pairs.unionByName(more), 2 * reach


def climb(tree: DataFrame, own: Column, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """(node, c): `own` of a node combined with that of its ancestors, the nearest first.

    Each round a node takes what the node it points to has gathered and points to where that
    one points, so rounds go with the log of the depth and a round has a row for each node.
    Nodes that are done aren't joined again, and rows that point to one node (in the last
    rounds most of a tree's point to its root) are joined in shares. combine(near, far) has to
    be associative and keep the type of `own`. Parents that make a cycle are an error.
    """
    state = cut(tree.select("node", F.col("parent").alias("ptr"), own.alias("c")))
    left = _rounds(state)
    while not (open_ := state.where("ptr IS NOT NULL")).isEmpty():
        left -= 1
        _cycle(left)
        far = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("next"), F.col("c").alias("far"))
        met = join_hot(open_, far, "ptr", "node", "left")
        met = met.select("node", F.col("next").alias("ptr"), F.when(F.col("far").isNull(), F.col("c")).otherwise(combine(F.col("c"), F.col("far"))).alias("c"))
        state = cut(state.where("ptr IS NULL").unionByName(met))
    return state.select("node", "c")


def descendant_counts(tree: DataFrame) -> DataFrame:
    """(node, total): how many nodes are below each node.

    After k rounds a node has counted those nearer than 2^k; those at 2^k below it point to it,
    each node to one, and add what they have counted.
    """
    state = cut(tree.select("node", F.col("parent").alias("ptr"), F.lit(1).cast("bigint").alias("n")))
    left = _rounds(state)
    while not (open_ := state.where("ptr IS NOT NULL")).isEmpty():
        left -= 1
        _cycle(left)
        below = open_.groupBy(F.col("ptr").alias("node")).agg(F.sum("n").alias("more"))
        far = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("next"))
        moved = join_hot(open_, far, "ptr", "node", "left").select("node", F.col("next").alias("ptr"), "n").unionByName(state.where("ptr IS NULL"))
        state = cut(moved.join(below, "node", "left").select("node", "ptr", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
    return state.select("node", (F.col("n") - 1).alias("total"))


def tree_to_graph(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with all their columns but the place in the tree, and edges (src, dst) from parents to children.

    A parent that has no row of its own gets none: its edges are left out.
    """
    nodes = tree.drop("parent", "child_idx")
    edges = tree.where("parent IS NOT NULL").select(F.col("parent").alias("src"), F.col("node").alias("dst"))
    return nodes, edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")


def child_counts(tree: DataFrame) -> DataFrame:
    direct = tree.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("direct"))
    return descendant_counts(tree).join(direct, "node", "left").select("node", F.coalesce("direct", F.lit(0).cast("bigint")).alias("direct"), "total")


def earlier_ranges(ranges: DataFrame, group: str, held: Column) -> DataFrame:
    """(__group, __of, __before): what the group holds in the ranges before the range __of, for groups that go on in it.

    ranges has the column __part. Rows are dealt by (group, order), so only its first group goes on in a
    range: a row for a range at most, whatever the number of groups, which is small enough to broadcast.
    """
    first = ranges.groupBy("__part").agg(F.min(F.struct(F.col(group).alias("g"))).alias("f")).select(F.col("f.g").alias("__g")).distinct()
    met = ranges.join(F.broadcast(first), F.col(group).eqNullSafe(F.col("__g")), "left_semi")
    going = met.groupBy(F.col(group).alias("__group"), F.col("__part").alias("__of")).agg(held.alias("__held"))
    before = F.sum("__held").over(Window.partitionBy("__group").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1))
    return F.broadcast(going.select("__group", "__of", before.alias("__before")).where("__before IS NOT NULL"))


def running_sums(df: DataFrame, group: str, order: list[Column], value: str) -> DataFrame:
    """Adds `before`: the sum of `value` over the rows before a row within its group, 0 for the first.

    Rows are dealt into ranges of (group, order); sums within a range and of the ranges
    before it make one, so a large group is many tasks' work.
    """
    ranges = cut(df.repartitionByRange(F.col(group).asc(), *order).withColumn("__part", F.spark_partition_id()))
    within = ranges.withColumn("__within", F.sum(value).over(Window.partitionBy(group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value))
    both = within.join(earlier_ranges(ranges, group, F.sum(value)), F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__of")), "left")
    return both.select(*df.columns, (F.coalesce("__before", F.lit(0)) + F.col("__within")).alias("before"))


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges and density of a graph (0 for one node or none)."""
    n, m = nodes.agg(F.count("*").alias("n")), edges.agg(F.count("*").alias("m"))
    both = n.join(m, F.lit(True))
    return both.select("n", "m", F.round(F.when(F.col("n") > 1, F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0), 8).alias("density"))


def apply_skips(edges: DataFrame, skipped: DataFrame) -> DataFrame:
    """Nodes that become ignored when the skipped nodes take all descendants with them."""
    return reached(_plain(edges), edges, skipped).unionByName(skipped.select("node")).distinct()


def tree_order(tree: DataFrame, how: str = "dfs", flipped: bool = False) -> DataFrame:
    """(node, depth, at): visiting order of trees (node, parent, child_idx), without a sort of all nodes.

    dfs: `at` is the place from 0, children in the order they were added. bfs: order by depth,
    then `at`, children in the reverse order. flipped turns the children round. A node comes
    after its ancestors and after the whole subtrees of earlier siblings of itself and of
    them, so places are sums on the way to the root.
    """
    added = (how == "dfs") != flipped
    sized = tree.select("node", "parent", "child_idx").join(descendant_counts(tree).select("node", (F.col("total") + 1).alias("n")), "node")
    order = [F.col("child_idx").asc(), F.col("node").asc()] if added else [F.col("child_idx").desc(), F.col("node").desc()]
    earlier = running_sums(sized, "parent", order, "n")
    own = F.struct(F.lit(1).alias("depth"), (F.col("before") + 1).alias("steps"))
    summed = climb(earlier, own, lambda x, y: F.struct((x["depth"] + y["depth"]).alias("depth"), (x["steps"] + y["steps"]).alias("steps")))
    return summed.select("node", (F.col("c.depth") - 1).alias("depth"), (F.col("c.steps") - 1).alias("at"))


# ---------------------------------------------------------------- many graphs, kinds of nodes
def left_over(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes on or behind a cycle, with their columns."""
    return nodes.join(shuffled(topological_levels(nodes, edges).select("node")), "node", "left_anti")


def acyclic_graphs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, acyclic, left_over): for each graph whether it has no cycle, and how many nodes are on or behind one."""
    stuck = left_over(nodes, edges).groupBy("graph").agg(F.count("*").alias("left_over"))
    all_ = nodes.select("graph").distinct().join(stuck, "graph", "left")
    return all_.select("graph", F.col("left_over").isNull().alias("acyclic"), F.coalesce("left_over", F.lit(0).cast("bigint")).alias("left_over"))


def graph_summaries(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, n, m, density, acyclic) for each graph; density m / (n (n - 1)), 0 for one node."""
    n = nodes.groupBy("graph").agg(F.count("*").alias("n"))
    m = edges.groupBy("graph").agg(F.count("*").alias("m"))
    both = n.join(m, "graph", "left").withColumn("m", F.coalesce("m", F.lit(0).cast("bigint"))).join(acyclic_graphs(nodes, edges), "graph")
    density = F.when(F.col("n") > 1, F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)
    return both.select("graph", "n", "m", F.round(density, 8).alias("density"), "acyclic")


KINDS = ("flow", "retry", "task")


def _ways(nodes: DataFrame, edges: DataFrame, forward: bool, through: tuple[str, ...]) -> DataFrame:
    """(at, node, open, shown): steps to nodes (node, kind, noop); of some kinds they are open, those that aren't noop are shown."""
    ways = edges.select(F.col("src").alias("at"), F.col("dst").alias("node")) if forward else edges.select(F.col("dst").alias("at"), F.col("src").alias("node"))
    kinds = nodes.select("node", F.coalesce(F.col("kind").isin(list(through)), F.lit(False)).alias("open"), (~F.coalesce("noop", F.lit(False))).alias("shown"))
    return ways.distinct().join(shuffled(kinds), "node").select("at", "node", "open", "shown")


def connected(nodes: DataFrame, edges: DataFrame, start: DataFrame, forward: bool = False, through: tuple[str, ...] = KINDS) -> DataFrame:
    """(start, node, hops): ancestors() that goes on only through nodes of some kinds.

    nodes: (node, kind, noop). A node of another kind is found and not passed; a noop node is
    passed and not returned.
    """
    return _rounds_of_pairs(cut(_ways(nodes, edges, forward, through)), start.select(F.col("node").alias("start")).distinct())


def connected_pairs(nodes: DataFrame, edges: DataFrame, through: tuple[str, ...] = KINDS, most: int | None = None) -> DataFrame:
    """connected() from all nodes, over at most so many hops, inside tasks (see subgraphs): pairs of nodes are neither shuffled nor stored."""
    return _pairs(_ways(nodes, edges, False, through), nodes, most)


def reached(nodes: DataFrame, edges: DataFrame, start: DataFrame, forward: bool = True, through: tuple[str, ...] = KINDS) -> DataFrame:
    """(node): what connected() finds from any of the start nodes, noop nodes too; a row for a node, not for a pair."""
    ways = edges.select(F.col("src").alias("at"), F.col("dst").alias("node")) if forward else edges.select(F.col("dst").alias("at"), F.col("src").alias("node"))
    ways = cut(ways.distinct().join(shuffled(nodes.select("node", F.col("kind").isin(list(through)).alias("open"))), "node"))
    frontier, seen, rounds = cut(start.select(F.col("node").alias("at")).distinct()), None, 0
    while True:
        found = frontier.join(shuffled(ways), "at").select("node", "open").distinct()
        found = cut(found if seen is None else found.join(shuffled(seen.select("node")), "node", "left_anti"))
        if found.isEmpty():
            return (seen if seen is not None else found).select("node")
        rounds += 1
        seen = _grown(seen, found, rounds)
        frontier = found.where("open").select(F.col("node").alias("at"))


def ready_for(nodes: DataFrame, edges: DataFrame, action: str = "execute") -> DataFrame:
    """(node): atoms that may be executed or reverted now. nodes: (node, kind, noop, state, intention).

    execute: PENDING with intention EXECUTE, and every ancestor is SUCCESS or IGNORE with
    intention EXECUTE or IGNORE. revert: SUCCESS or FAILURE with intention REVERT or RETRY, and
    every descendant is PENDING, REVERTED or IGNORE. Nodes that stand in the way block all
    that they reach, so sets of nodes are walked, not pairs.
    """
    state, intention = F.col("state"), F.col("intention")
    if action == "execute":
        may, fine = state.isin("PENDING") & (intention == "EXECUTE"), state.isin("SUCCESS", "IGNORE") & intention.isin("EXECUTE", "IGNORE")
    else:
        may, fine = state.isin("SUCCESS", "FAILURE") & intention.isin("REVERT", "RETRY"), state.isin("PENDING", "REVERTED", "IGNORE")
    real = ~F.coalesce("noop", F.lit(False))
    blocked = reached(nodes, edges, nodes.where(real & ~F.coalesce(fine, F.lit(False))), forward=action == "execute")
    return nodes.where(real & may).join(blocked, "node", "left_anti").select("node")


# Depths of deciders, the widest first.
DEPTHS = ["ALL", "FLOW", "NEIGHBORS", "ATOM"]


def apply_deciders(nodes: DataFrame, edges: DataFrame, vote: Column | None = None) -> DataFrame:
    """(node, depth): atoms that become IGNORE because of votes on the edges to them.

    nodes: (node, kind, noop, state); edges: (src, dst, vote, depth), vote null where an edge
    has no decider, or the votes are given by a Column over edges and `src_state`. An atom
    that is IGNOREd itself doesn't vote. Of the false votes for a node the one with the widest
    depth counts: ALL takes all descendants along, FLOW those reached through tasks only,
    NEIGHBORS the tasks directly behind, ATOM none. depth is that of the node's own votes,
    null if it goes with another node.
    """
    sources = nodes.select(F.col("node").alias("src"), F.col("kind").alias("src_kind"), F.col("state").alias("src_state"))
    cast = edges.join(sources, "src").withColumn("vote", vote if vote is not None else F.col("vote"))
    silent = F.col("src_kind").isin("task", "retry") & (F.col("src_state") == "IGNORE")
    rank = F.array_position(F.array(*map(F.lit, DEPTHS)), F.col("depth"))
    nays = cast.where(~F.coalesce(silent, F.lit(False)) & (F.col("vote") == F.lit(False))).groupBy(F.col("dst").alias("node")).agg(F.min(rank).alias("rank"))
    nays = cut(nays.select("node", F.get(F.array(*map(F.lit, DEPTHS)), (F.col("rank") - 1).cast("int")).alias("depth")))
    of = lambda depth: nays.where(F.col("depth") == depth).select("node")
    near = edges.join(of("NEIGHBORS").withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"))
    near = near.join(nodes.where("kind = 'task'").select("node"), "node", "left_semi")
    along = reached(nodes, edges, of("ALL")).unionByName(reached(nodes, edges, of("FLOW"), through=("task",))).unionByName(near)
    atoms = nodes.where(F.col("kind").isin("task", "retry") & ~F.coalesce("noop", F.lit(False))).select("node")
    return atoms.join(along.unionByName(nays.select("node")).distinct(), "node", "left_semi").join(nays, "node", "left")


def reset_from(nodes: DataFrame, edges: DataFrame, starts: DataFrame, state: str | None = "PENDING", intention: str | None = "EXECUTE", with_start: bool = False) -> DataFrame:
    """nodes (node, kind, noop, state, intention) with the descendants of the starts set, and the starts if asked.

    A state or intention of None stays. Intention REVERT isn't changed to RETRY.
    """
    hit = reached(nodes, edges, starts)
    hit = (hit.unionByName(starts.select("node")) if with_start else hit).distinct().withColumn("__hit", F.lit(True))
    kept = F.lit(intention == "RETRY") & F.coalesce(F.col("intention") == "REVERT", F.lit(False))
    change = F.col("__hit").isNotNull() & ~F.coalesce("noop", F.lit(False)) & ~kept
    own = lambda c, v: F.col(c) if v is None else F.when(change, v).otherwise(F.col(c)).alias(c)
    return nodes.join(hit, "node", "left").select("node", own("state", state), own("intention", intention))


def lineages(tree: DataFrame) -> DataFrame:
    """(node, path array<struct<node, idx>>): each node's way from the root, itself at the end."""
    steps = tree_paths(tree).select("node", F.col("ancestor").alias("at"), "distance").unionByName(tree.select("node", F.col("node").alias("at"), F.lit(0).alias("distance")))
    steps = steps.join(tree.select(F.col("node").alias("at"), F.col("child_idx").alias("idx")), "at")
    path = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "at", "idx"))), lambda s: F.struct(s["at"].alias("node"), s["idx"].alias("idx")))
    return steps.groupBy("node").agg(path.alias("path"))


def visible_scopes(tree: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level, at, visible): the atoms that each atom can see, by level outward, nearest first.

    tree: (node, parent, child_idx); nodes: (node, kind, noop), atoms are tasks and retries. Seen
    are ancestors in the graph that stand before the atom, or before the flow that holds it,
    under a common parent; level 0 is the atom's own flow, and each is seen at the innermost
    level only. Within a level the last added come first.
    """
    atoms = nodes.where(F.col("kind").isin("task", "retry")).select("node")
    pairs = connected(nodes, edges, atoms).join(atoms, "node", "left_semi").select(F.col("start").alias("node"), F.col("node").alias("visible"))
    way = lineages(tree)
    both = pairs.join(way, "node").join(way.select(F.col("node").alias("visible"), F.col("path").alias("other")), "visible")
    common = F.size(F.filter(F.zip_with("path", "other", lambda x, y: F.coalesce(x["node"] == y["node"], F.lit(False))), lambda same: same))
    both = both.withColumn("common", common)
    before = F.get("other", F.col("common"))["idx"] < F.get("path", F.col("common"))["idx"]
    places = F.transform(F.slice("other", F.col("common") + 1, F.size("other")), lambda s: -s["idx"])
    seen = both.where(before).select("node", (F.size("path") - 1 - F.col("common")).alias("level"), "visible", places.alias("places"))
    order = Window.partitionBy("node", "level").orderBy("places", "visible")
    return seen.select("node", "level", F.row_number().over(order).alias("at"), "visible")


def tree_numbers(tree: DataFrame) -> DataFrame:
    """(node, depth, entry, until, back): the numbers of a walk through the tree (node, parent, child_idx).

    A node's subtree has the entries from its own to before `until`; children in the order they were added, roots as
    children of one parent. back: the place in the walk that takes the last added child first.
    """
    first, last = tree_order(tree), tree_order(tree, flipped=True).select("node", F.col("at").alias("back"))
    return first.join(last, "node").join(descendant_counts(tree), "node").select("node", "depth", F.col("at").alias("entry"), (F.col("at") + F.col("total") + 1).alias("until"), "back")


def scopes_by_numbers(tree: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """visible_scopes() without the ancestors of each node: numbers of a walk tell what is before, inside or around.

    Where the ways of an atom and one that it may see part is found by lifting: the atom's pointer
    goes up by halving powers of two as long as the other one isn't below, so a pair is a row of
    a few numbers however deep the tree is.
    """
    atoms = nodes.where(F.col("kind").isin("task", "retry")).select("node")
    numbers = cut(tree_numbers(tree))
    inside = lambda x, entry, until: (F.col(entry) <= F.col(x)) & (F.col(x) < F.col(until))
    pairs = connected(nodes, edges, atoms).join(atoms, "node", "left_semi").select(F.col("start").alias("node"), F.col("node").alias("visible"))
    pairs = pairs.join(numbers.select("node", F.col("depth").alias("d"), "entry"), "node")
    pairs = pairs.join(numbers.select(F.col("node").alias("visible"), F.col("entry").alias("v"), F.col("until").alias("v_until"), "back"), "visible")
    pairs = pairs.where((F.col("v") < F.col("entry")) & ~inside("entry", "v", "v_until")).drop("v_until", "entry").withColumn("at", F.col("node"))
    lifts = [cut(tree.where("parent IS NOT NULL").select(F.col("node").alias("at"), F.col("parent").alias("up")))]
    for _ in range((numbers.agg(F.max("depth")).first()[0] or 0).bit_length()):
        lifts.append(cut(lifts[-1].join(lifts[-1].select(F.col("at").alias("up"), F.col("up").alias("far")), "up").select("at", F.col("far").alias("up"))))
    for lift in reversed(lifts):
        higher = lift.join(numbers.select(F.col("node").alias("up"), F.col("entry").alias("from"), "until"), "up")
        pairs = pairs.join(higher, "at", "left")
        goes = F.col("up").isNotNull() & ~inside("v", "from", "until")
        pairs = pairs.withColumn("at", F.when(goes, F.col("up")).otherwise(F.col("at"))).drop("up", "from", "until")
    seen = pairs.join(numbers.select(F.col("node").alias("at"), F.col("depth").alias("parted")), "at")
    order = Window.partitionBy("node", "level").orderBy("back", "visible")
    return seen.select("node", (F.col("d") - F.col("parted")).alias("level"), "visible", "back").withColumn("at", F.row_number().over(order)).select("node", "level", "at", "visible")


def merge_graph_list(graphs: list[tuple[DataFrame, DataFrame]], allow_overlaps: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes (by `node`) and edges (by `src`, `dst`) of many graphs; of overlapping ones the attributes of the last graph count.

    Without permission to overlap, nodes in more than one graph are an error that tells their number.
    """

    def merged(frames: list[DataFrame], keys: list[str]) -> DataFrame:
        rows = None
        for number, df in enumerate(frames):
            df = df.withColumn("__graph", F.lit(number))
            rows = df if rows is None else rows.unionByName(df, allowMissingColumns=True)
        names = [c for c in rows.columns if c != "__graph"]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "__graph").alias("row"), F.countDistinct("__graph").alias("__graphs"))

    nodes = merged([n for n, _ in graphs], ["node"])
    if not allow_overlaps and (n := nodes.where(F.col("__graphs") > 1).count()):
        raise ValueError(f"{n} nodes are in more than one graph")
    return nodes.select("row.*"), merged([e for _, e in graphs], ["src", "dst"]).select("row.*")

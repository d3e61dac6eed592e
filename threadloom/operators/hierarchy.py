"""Parent-child rows to full hierarchies by pointer doubling.

Every node holds a pointer to an ancestor and its distance. A round replaces each pointer by the
pointer of the node it leads to, so reach doubles and a forest of depth d needs about log2(d)
rounds. A node still open when a round settles no other one lies on a cycle or leads into one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.runtime import Stage


def _nodes(rows: DataFrame, node: str, parent: str) -> DataFrame:
    """One row per node with its parent; among several the smallest non-null parent counts."""
    return (
        rows.select(F.col(node).cast("string").alias("id"), F.nullif(F.col(parent).cast("string"), F.lit("")).alias("up"))
        .where("id is not null and id <> ''")
        .groupBy("id")
        .agg(F.min("up").alias("up"))
    )


def _doubled(open_: DataFrame, state: DataFrame, with_path: bool) -> DataFrame:
    """Open rows with the pointers of the nodes they lead to, all of which have a row: an inner join, so that few open rows cost no shuffle of the rest."""
    q = state.select(
        F.col("id").alias("q_id"), F.col("anc").alias("q_anc"), F.col("dist").alias("q_dist"), F.col("done").alias("q_done"), *([F.col("path").alias("q_path")] if with_path else [])
    )
    path = [F.concat("path", "q_path").alias("path")] if with_path else []
    return open_.join(q, F.col("anc") == F.col("q_id")).select("id", F.col("q_anc").alias("anc"), (F.col("dist") + F.col("q_dist")).alias("dist"), F.col("q_done").alias("done"), *path)


def resolve(rows: DataFrame, node: str, parent: str, with_path: bool = False) -> DataFrame:
    """One row per distinct non-null, non-empty node: id, root, depth, cyclic[, path].

    ``root`` is the end of the chain of parents, or the last parent named if that node has no row
    of its own; ``depth`` counts the steps to it. On a chain that never ends (a node that is its
    own parent included) depth is -1, cyclic is true and root is the smallest id of the cycle that
    the chain runs into. ``path`` lists the ids from the root down to the node, null if cyclic.
    Repeated rows count once; of differing parents the smallest non-null counts; an empty parent
    is none; an empty table gives no rows.
    """
    stage = Stage(rows.sparkSession, "hierarchy")
    settled, never = _settle(_nodes(rows, node, parent), stage, with_path)
    if never is None:
        return settled
    loops = _cycles(never, stage).select(
        "id", "root", F.lit(-1).cast("long").alias("depth"), F.lit(True).alias("cyclic"), *([F.lit(None).cast("array<string>").alias("path")] if with_path else [])
    )
    return settled.unionByName(loops)


def _settle(nodes: DataFrame, stage: Stage, with_path: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Resolved rows (id, root, depth, cyclic[, path]) of nodes(id, up), and the nodes (id, up) whose chain never ends, null if none."""
    nodes = stage.put(nodes.select("id", "up"))
    known = nodes.select(F.col("id").alias("known"))
    # a chain ends at a node without parent, or at a parent without a row
    start = nodes.join(known, F.col("up") == F.col("known"), "left").select(
        "id",
        F.coalesce("up", "id").alias("anc"),
        F.col("up").isNotNull().cast("long").alias("dist"),
        F.col("known").isNull().alias("done"),
        *([F.when(F.col("up").isNull(), F.array().cast("array<string>")).otherwise(F.array("up")).alias("path")] if with_path else []),
    )
    still = F.count(F.when(~F.col("done"), 1))
    # each round's rows are written once: settled ones stay where they are, open ones are superseded
    rounds = [stage.put(start, left=still)]
    left, before = stage.seen["left"], None

    def settled() -> DataFrame:
        return reduce(DataFrame.union, [r.where("done") for r in rounds])

    while left and left != before:
        open_ = rounds[-1].where("not done")
        rounds.append(stage.put(_doubled(open_, settled().union(open_), with_path), left=still))
        left, before = stage.seen["left"], left
    out = settled().select(
        "id", F.col("anc").alias("root"), F.col("dist").alias("depth"), F.lit(False).alias("cyclic"), *([F.reverse(F.concat(F.array("id"), "path")).alias("path")] if with_path else [])
    )
    return out, stage.put(nodes.join(rounds[-1].where("not done").select("id"), "id", "left_semi")) if left else None


def entered_roots(nodes: DataFrame) -> DataFrame:
    """(id, root, depth) of nodes(id, up). A node on a cycle is its own root, and a chain into a cycle ends where it enters."""
    stage = Stage(nodes.sparkSession, "roots")
    settled, never = _settle(nodes, stage)
    if never is None:
        return settled.select("id", "root", "depth")
    on = stage.put(_onto_cycles(never, stage).select(F.col("anc").alias("on_id")).distinct())
    cut = never.join(on, F.col("id") == F.col("on_id"), "left").select("id", F.when(F.col("on_id").isNull(), F.col("up")).alias("up"))
    return settled.select("id", "root", "depth").union(_settle(cut, stage)[0].select("id", "root", "depth"))


def _onto_cycles(never: DataFrame, stage: Stage) -> DataFrame:
    """(id, anc) where anc, some power-of-two steps up, lies on the cycle that the chain runs into."""
    jump = stage.put(never.select("id", F.col("up").alias("anc")))
    image = jump.select("anc").distinct().count()
    while True:
        q = jump.select(F.col("id").alias("q_id"), F.col("anc").alias("q_anc"))
        nxt = stage.put(jump.join(q, F.col("anc") == F.col("q_id")).select("id", F.col("q_anc").alias("anc")))
        stage.drop(jump)
        jump, before = nxt, image
        image = jump.select("anc").distinct().count()
        if image == before:  # a jump maps these nodes onto each other: they are the cycles
            return jump


def _cycles(never: DataFrame, stage: Stage) -> DataFrame:
    """(id, root) of nodes whose chain never ends; root is the smallest id on the cycle."""
    jump = _onto_cycles(never, stage)
    on = stage.put(jump.select(F.col("anc").alias("id")).distinct())
    low = stage.put(never.join(on, "id", "left_semi").select("id", F.col("up").alias("anc"), F.col("id").alias("low")))
    while True:
        q = low.select(F.col("id").alias("q_id"), F.col("anc").alias("q_anc"), F.col("low").alias("q_low"))
        nxt = low.join(q, F.col("anc") == F.col("q_id")).select("id", F.col("q_anc").alias("anc"), F.least("low", "q_low").alias("low"), (F.col("q_low") < F.col("low")).alias("fell"))
        low = stage.put(nxt, fell=F.count(F.when(F.col("fell"), 1)))
        if not stage.seen["fell"]:
            break
    lows = low.select(F.col("id").alias("on_id"), F.col("low").alias("root"))
    return jump.join(lows, F.col("anc") == F.col("on_id")).select("id", "root")


def closure(resolved: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, distance) of every non-cyclic node with a path; a root that has no row appears as ancestor too."""
    steps = resolved.where("not cyclic").select(F.col("id").alias("descendant_id"), F.posexplode("path").alias("at", "ancestor_id"), (F.size("path") - 1).alias("deep"))
    return steps.where("at < deep").select("ancestor_id", "descendant_id", (F.col("deep") - F.col("at")).cast("long").alias("distance"))


def hierarchy(rows: DataFrame, node: str, parent: str) -> DataFrame:
    """id, path (``a>b>c`` from the root, null if cyclic), depth, root, n_descendants.

    Descendants of cyclic nodes are not counted (null), as they would be their own.
    """
    full = resolve(rows, node, parent, with_path=True)
    counts = closure(full).groupBy(F.col("ancestor_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return full.join(counts, "id", "left").select(
        "id", F.array_join("path", ">").alias("path"), "depth", "root", F.when(F.col("cyclic"), F.lit(None)).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_descendants")
    )

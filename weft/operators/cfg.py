"""Control-flow graphs as edge tables: degrees, basic blocks, labels, bounded paths.

nodes: method, node, line. edges: method, src, dst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with n_in, n_out and the flags entry, exit, branch, join."""
    e = edges.distinct()
    outs = e.groupBy("method", F.col("src").alias("node")).agg(F.count("*").alias("n_out"))
    ins = e.groupBy("method", F.col("dst").alias("node")).agg(F.count("*").alias("n_in"))
    out = nodes.join(outs, ["method", "node"], "left").join(ins, ["method", "node"], "left").fillna(0, ["n_in", "n_out"])
    return out.withColumns({"is_entry": F.col("n_in") == 0, "is_exit": F.col("n_out") == 0, "is_branch": F.col("n_out") > 1, "is_join": F.col("n_in") > 1})


def basic_blocks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with `leader`, the first node of their block, and `place` in it.

    A node leads a block if it is an entry, has not exactly one predecessor, or its predecessor branches. Every
    other node points to its predecessor; pointers are doubled until all point to leaders, so a block of
    n nodes takes log2(n) joins. Nodes of a ring without a leader are led by the smallest of them, without place.
    """
    d = degrees(nodes, edges)
    e = edges.distinct().join(d.select("method", F.col("node").alias("src"), F.col("n_out").alias("_n")), ["method", "src"])
    single = e.groupBy("method", F.col("dst").alias("node")).agg(F.count("*").alias("_in"), F.max("_n").alias("_out"), F.min("src").alias("pred"))
    single = single.where("_in = 1 and _out = 1 and pred <> node").select("method", "node", "pred")
    own = nodes.select("method", "node").distinct().join(single, ["method", "node"], "left")
    points = own.select("method", "node", F.coalesce("pred", "node").alias("up"), F.when(F.col("pred").isNull(), 0).otherwise(1).alias("steps"), F.least("node", "pred").alias("low"))
    leads = own.where("pred is null").select("method", F.col("node").alias("up"), F.lit(True).alias("_done"))
    points = cut(points.join(leads, ["method", "up"], "left").withColumn("done", F.coalesce("_done", F.lit(False))).drop("_done"))
    longest = points.where("not done").groupBy("method").count().agg(F.max("count")).first()[0] or 0
    span = 1
    while span <= longest:
        over = points.select("method", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps"), F.col("low").alias("_low"), F.col("done").alias("_done"))
        points = cut(points.join(over, ["method", "up"]).select("method", "node", F.col("_up").alias("up"), (F.col("steps") + F.col("_steps")).alias("steps"), F.least("low", "_low").alias("low"), F.col("_done").alias("done")))
        span *= 2
        if points.where("not done").isEmpty():
            break
    leader, place = F.when(F.col("done"), F.col("up")).otherwise(F.col("low")), F.when(F.col("done"), F.col("steps"))
    return nodes.join(points.select("method", "node", leader.alias("leader"), place.alias("place")), ["method", "node"])


def block_summary(blocks: DataFrame, max_nodes: int = 80) -> DataFrame:
    """method, leader, n_nodes, first and last line, the first nodes in order."""
    listed = F.slice(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("place", F.lit(0)).alias("place"), "node"))), lambda x: x["node"]), 1, max_nodes)
    return blocks.groupBy("method", "leader").agg(F.count("*").alias("n_nodes"), F.min("line").alias("first_line"), F.max("line").alias("last_line"), listed.alias("block_nodes"))


def edge_labels(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """method, src, dst, label by the order of the successors' first lines.

    blocks: method, block, kind (condition, loop, try, switch or other), first_line.
    """
    lines = blocks.select("method", F.col("block").alias("dst"), F.col("first_line").alias("_line"))
    kinds = blocks.select("method", F.col("block").alias("src"), F.col("kind").alias("_kind"))
    n = F.row_number().over(Window.partitionBy("method", "src").orderBy("_line", "dst"))
    many = F.count("*").over(Window.partitionBy("method", "src"))
    out = edges.distinct().join(lines, ["method", "dst"]).join(kinds, ["method", "src"]).withColumns({"_n": n, "_many": many})
    two = lambda a, b: F.when(F.col("_n") == 1, a).when(F.col("_n") == 2, b)
    label = (
        F.when(F.col("_many") == 1, F.lit(""))
        .when(F.col("_kind") == "switch", F.concat(F.lit("case_"), F.col("_n")))
        .when((F.col("_kind") == "condition") & (F.col("_many") == 2), two("true", "false"))
        .when((F.col("_kind") == "loop") & (F.col("_many") == 2), two("loop_body", "loop_exit"))
        .when((F.col("_kind") == "try") & (F.col("_many") == 2), two("normal", "exception"))
        .otherwise(F.concat(F.lit("branch_"), F.col("_n")))
    )
    return out.select("method", "src", "dst", label.alias("label"))


def block_paths(edges: DataFrame, entries: DataFrame, max_paths: int = 8, max_depth: int = 20) -> DataFrame:
    """method, n, path, conditions: the first paths of each method in depth-first order, cut at max_depth nodes.

    A path ends where no successor is left that it doesn't hold already (a node may follow itself once). conditions: the labels of
    its edges (column label of edges, else flow). All paths grow by one node a round. A path that isn't ended yields one path at
    least, and its order among others stays as it is, so the max_paths first of a method, ended or not, are all that a round
    hands on: as many rows a method, whatever the number of its paths.
    """
    label = F.col("label") if "label" in edges.columns else F.lit("flow")
    links = edges.select("method", F.col("src").alias("_last"), F.col("dst").alias("_to"), label.alias("_label")).dropDuplicates(["method", "_last", "_to"])
    links = cut(links.groupBy("method", "_last").agg(F.sort_array(F.collect_list(F.struct("_to", "_label"))).alias("_next")))
    first = F.row_number().over(Window.partitionBy("method").orderBy("_path"))
    best = lambda rows: rows.withColumn("n", first).where(F.col("n") <= max_paths)
    start = entries.select("method", F.array("node").alias("_path"), F.array().cast("array<string>").alias("_labels"), F.lit(False).alias("_ended")).distinct()
    paths = cut(best(start))
    for length in range(1, max_depth):
        open_ = paths.where("not _ended").withColumn("_last", F.element_at("_path", -1)).join(links, ["method", "_last"], "left")
        held = F.slice("_path", 1, F.size("_path") - 1)
        open_ = open_.withColumn("_next", F.filter(F.coalesce("_next", F.array()), lambda x: ~F.array_contains(held, x["_to"])))
        grown = open_.withColumn("x", F.explode_outer("_next")).withColumn("_ended", F.col("x").isNull())
        add = lambda xs, x: F.when(F.col("x").isNull(), F.col(xs)).otherwise(F.concat(xs, F.array(x)))
        grown = grown.select("method", add("_path", F.col("x._to")).alias("_path"), add("_labels", F.col("x._label")).alias("_labels"), "_ended")
        paths = best(paths.where("_ended").drop("n").unionByName(grown))
        if length % 3 == 0 or length == max_depth - 1:
            paths = cut(paths)
            if paths.where("not _ended").isEmpty():
                break
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "/")
    return paths.select("method", F.col("n").cast("long").alias("n"), text("_path").alias("path"), F.col("_labels").alias("conditions"))


def report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for each method: nodes, edges, branches, joins, exits and whether an edge goes back to an earlier line."""
    d = degrees(nodes, edges).groupBy("method").agg(
        F.count("*").alias("n_nodes"), F.count_if("is_entry").alias("n_entries"), F.count_if("is_exit").alias("n_exits"),
        F.count_if("is_branch").alias("n_branches"), F.count_if("is_join").alias("n_joins"),
    )
    at = nodes.select("method", "node", "line")
    e = edges.distinct().join(at.withColumnsRenamed({"node": "src", "line": "_from"}), ["method", "src"]).join(at.withColumnsRenamed({"node": "dst", "line": "_to"}), ["method", "dst"])
    back = e.groupBy("method").agg(F.count("*").alias("n_edges"), F.bool_or(F.col("_to") <= F.col("_from")).alias("has_loop"))
    return d.join(back, "method", "left").fillna(0, ["n_edges"]).fillna(False, ["has_loop"])

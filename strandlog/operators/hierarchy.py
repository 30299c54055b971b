"""Parent-child links to full hierarchies by fragment contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Quotient links that one task solves at the end.
CAPACITY = 200_000

_LINK = "node string, parent string, dist int, low string"


def _contract(batches: Iterator[pa.RecordBatch], with_path: bool) -> Iterator[pa.RecordBatch]:
    """Follow each link up to where it leaves this partition.

    Gives (node, exit, dist, low, path): ``exit`` is the first ancestor whose own link is
    not here, ``dist`` the original links to it, ``low`` the smallest original name from
    the node up to before the exit, ``path`` the names passed, topmost first. A null exit
    means that the chain runs into a loop; ``low`` is then the smallest name on the loop.
    """
    up: dict[str, tuple] = {}
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("node", "parent", "dist", "low", *(["path"] if with_path else []))]
        for row in zip(*cols):
            up[row[0]] = row[1:]
    done: dict[str, tuple] = {}
    for start in up:
        trail: list[str] = []
        on_trail: dict[str, int] = {}
        x = start
        while x in up and x not in done and x not in on_trail:
            on_trail[x] = len(trail)
            trail.append(x)
            x = up[x][0]
        if x in on_trail:  # a loop within this fragment
            loop = trail[on_trail[x] :]
            low = min(up[y][2] for y in loop)
            for y in loop:
                done[y] = (None, -1, low)
            trail = trail[: on_trail[x]]
        for y in reversed(trail):
            parent, dist, low = up[y][:3]
            above = done.get(parent)
            if above is None:
                done[y] = (parent, dist, low)
            elif above[0] is None:
                done[y] = above
            else:
                done[y] = (above[0], dist + above[1], min(low, above[2]))

    def path_of(y: str) -> list[str]:
        parts = []
        end = done[y][0]
        while y != end:
            parts.append(up[y][3])
            y = up[y][0]
        return [name for part in reversed(parts) for name in part]

    names = ["node", "exit", "dist", "low", *(["path"] if with_path else [])]
    types = [pa.string(), pa.string(), pa.int32(), pa.string(), *([pa.list_(pa.string())] if with_path else [])]
    rows: list[tuple] = []
    held = 0

    def flush() -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    for y, (end, dist, low) in done.items():
        path = [path_of(y) if end is not None else None] if with_path else []
        rows.append((y, end, dist, low, *path))
        held += 1 + len(path[0] or ()) if path else 1
        if held > 100_000:  # names held, so long paths give small batches
            yield flush()
            rows.clear()
            held = 0
    if rows:
        yield flush()


def _fragments(links: DataFrame, seed: int, n_parts: int, hot_parents: list[str], with_path: bool, one: bool) -> DataFrame:
    if one:
        placed = links.coalesce(1)
    else:
        # a coin per name: a tail moves to its parent's place, so about a quarter of all links
        # becomes local whatever the shape; children of parents with very many stay where they are
        tail = F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(2)) == 1
        if hot_parents:
            tail = tail & ~F.col("parent").isin(hot_parents)
        placed = links.repartition(n_parts, F.when(tail, F.col("parent")).otherwise(F.col("node")))
    schema = "node string, exit string, dist int, low string" + (", path array<string>" if with_path else "")
    return placed.mapInArrow(lambda it: _contract(it, with_path), schema)


def _solve(links: DataFrame, level: int, capacity: int, fragment: int, with_path: bool) -> DataFrame:
    """(node, root, depth, low, path) of every link's node; depth -1 marks loops."""
    # past the first level a small quotient is one task's work
    n = links.count()
    one = level > 0 and n <= capacity
    hot: list[str] = []
    if not one:
        limit = max(1000, n // 1000)  # so at most a thousand names are hot
        hot = [r.parent for r in links.groupBy("parent").count().where(F.col("count") > limit).select("parent").collect()]
    n_parts = max(2, -(-n // fragment))
    cut = materialise(_fragments(links, level, n_parts, hot, with_path, one), "fragments")
    looped = F.col("exit").isNull()
    path = ["path"] if with_path else []
    if one:
        return cut.select("node", F.coalesce("exit", "low").alias("root"), F.when(looped, -1).otherwise(F.col("dist")).alias("depth"), *path)
    exits = cut.where(~looped).select(F.col("exit").alias("node")).distinct()
    # an exit on or below a loop already found goes on as a loop of its own with that loop's name
    quotient = cut.join(exits, "node", "left_semi").select("node", F.coalesce("exit", "node").alias("parent"), "dist", "low", *path)
    upper = _solve(materialise(quotient, "quotient"), level + 1, capacity, fragment, with_path)
    upper = upper.select(F.col("node").alias("exit"), F.col("root").alias("up_root"), F.col("depth").alias("up_depth"), *([F.col("path").alias("up_path")] if with_path else []))
    both = cut.join(upper, "exit", "left")
    depth = F.when(looped | (F.col("up_depth") == -1), -1).otherwise(F.col("dist") + F.coalesce("up_depth", F.lit(0)))
    full = [F.when(depth >= 0, F.concat(F.coalesce("up_path", F.array().cast("array<string>")), "path")).alias("path")] if with_path else []
    return both.select("node", F.coalesce("up_root", "exit", "low").alias("root"), depth.alias("depth"), *full)


def parent_links(relations: DataFrame, types: tuple[str, ...] = ("copy", "transform")) -> DataFrame:
    """``(node, parent)`` of relation rows of the given types; see :func:`hierarchy` for odd rows."""
    rows = relations.where(F.col("rel_type").isin(*types)).select(F.col("to_name").alias("node"), F.col("from_name").alias("parent"))
    return rows


def hierarchy(links: DataFrame, *, with_path: bool = False, capacity: int = CAPACITY, fragment: int = CAPACITY) -> DataFrame:
    """``(node_name, root_name, node_depth[, path])`` for each node that has a parent.

    ``links`` has columns ``node`` and ``parent``. Links are spread over fragments of about
    ``fragment`` links; inside a fragment every chain is contracted to its exit, the exits
    that have parents themselves form a smaller forest, which is solved the same way until
    ``capacity`` links are left, and the results are expanded level by level. Random
    placement makes each level at most about three quarters of the one before, so the
    number of levels grows with the logarithm of the links, not with the depth of the trees.

    ``path`` runs from the root to the node (its total size is the sum of all depths).
    On or below a loop ``root_name`` is the smallest name (by code point) on the loop,
    ``node_depth`` -1 and the path null; a node that is its own parent is a loop.
    Rows with a null node or parent are no links, repeated links count once, and of
    several different parents the smallest counts.
    """
    real = links.where("node IS NOT NULL AND parent IS NOT NULL").groupBy("node").agg(F.min("parent").alias("parent"))
    start = real.select("node", "parent", F.lit(1).alias("dist"), F.col("node").alias("low"), *([F.array("node").alias("path")] if with_path else []))
    solved = _solve(materialise(start, "links"), 0, capacity, fragment, with_path)
    path = [F.when(F.col("depth") >= 0, F.concat(F.array("root"), "path")).alias("path")] if with_path else []
    return solved.select(F.col("node").alias("node_name"), F.col("root").alias("root_name"), F.col("depth").alias("node_depth"), *path)


def _pairs(paths: DataFrame, *kept: str) -> DataFrame:
    above = paths.where("path IS NOT NULL").select(F.col("node_name").alias("descendant"), "node_depth", *kept, F.posexplode("path").alias("at", "node_name"))
    return above.where(F.col("at") < F.col("node_depth")).select("node_name", "descendant", (F.col("node_depth") - F.col("at")).alias("distance"), *kept)


def descendants(paths: DataFrame) -> DataFrame:
    """``(node_name, descendant, distance)``: all nodes below each node, from ``hierarchy(with_path=True)``.

    Nodes on or below a loop have no path and so no descendants here; :func:`below` has them too.
    """
    return _pairs(paths)


def below(links: DataFrame, *, capacity: int = CAPACITY, fragment: int = CAPACITY) -> DataFrame:
    """``(node_name, descendant, distance, loop_name)``: all nodes below each node, loops included.

    ``links`` is as in :func:`hierarchy`. ``loop_name`` is the smallest name on the loop
    that both nodes are on or below, null where there is none. Of a chain that runs round
    a loop only the first round counts: each pair comes once, with its smallest distance,
    and no node comes below itself.

    Each loop is cut above its smallest name, which leaves a tree with that root. The
    pairs within the tree are read off its paths; the cut link adds, for each node of the
    loop, the nodes that hang from the loop's nodes above it. The output of a loop grows
    with its length times the nodes on and below it.
    """
    paths = materialise(hierarchy(links, with_path=True, capacity=capacity, fragment=fragment), "paths")
    looped = paths.where("node_depth = -1")
    first = looped.where("node_name = root_name").select(F.col("node_name").alias("node"))
    cut = links.join(looped.where("node_name <> root_name").select(F.col("node_name").alias("node")), "node", "left_semi")
    tree = materialise(hierarchy(cut, with_path=True, capacity=capacity, fragment=fragment), "looped_paths").withColumnRenamed("root_name", "loop_name")
    # the path to the node above the cut holds exactly the nodes of the loop
    closing = links.join(first, "node", "left_semi").groupBy("node").agg(F.min("parent").alias("node_name"))
    loops = closing.join(tree, "node_name").select("loop_name", F.col("path").alias("loop"))
    nodes = tree.select("node_name", "loop_name", "node_depth", "path").unionByName(loops.select(F.col("loop_name").alias("node_name"), "loop_name", F.lit(0).alias("node_depth"), F.array("loop_name").alias("path")))
    length, hang = F.size("loop"), F.size(F.array_intersect("path", "loop"))  # a common beginning
    round_ = nodes.join(loops, "loop_name").select(F.col("node_name").alias("descendant"), "loop_name", "node_depth", length.alias("length"), hang.alias("hang"), F.posexplode(F.slice("loop", hang + 1, length)).alias("at", "node_name"))
    round_ = round_.select("node_name", "descendant", (F.col("length") - F.col("hang") - F.col("at") + F.col("node_depth")).alias("distance"), "loop_name")
    return _pairs(paths).withColumn("loop_name", F.lit(None).cast("string")).unionByName(_pairs(tree, "loop_name")).unionByName(round_)

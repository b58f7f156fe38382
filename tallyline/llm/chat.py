"""Chat formatting of reply trees: iterative self-joins follow replies to their root, branches are ranked by score, and each
chosen root-to-leaf path becomes one conversation.

Every round of the self-join doubles how far a message has looked up, so a thread of n turns takes log2(n) rounds and one
row for each message and round; paths are spelled out for chosen leaves only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import named, stored

# Control strings of the template.  Every one begins with < or #, which texts and roles cannot hold once escaped.
TURN, AFTER_ROLE, END_TURN = "### ", ":\n", "</turn>\n"
# Fixed values: (character, escape), the escape character first.  In a role the colon is escaped too, as it ends the role.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escaped(text: Column, escapes: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    for character, code in escapes:
        text = F.replace(text, F.lit(character), F.lit(code))
    return text


def unescaped(text: Column, escapes: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    for character, code in reversed(escapes):
        text = F.replace(text, F.lit(code), F.lit(character))
    return text


def threads(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(tree, node, parent, score, role, text): a table of turns as reply trees of one branch, each turn a reply to the one
    before it in its conversation.

    Rows are ordered by turn (a missing one first), then role, then text, all in one range-partitioned order over
    conversations: a conversation that holds many of the rows spans partitions, and each partition's last row is carried
    over to the next.  Equal rows are two turns.  A missing conversation id is a conversation.
    """
    spark = rows.sparkSession
    picked = rows.select(named(conv_col).alias("tree"), named(turn_col).alias("turn"), named(role_col).alias("role"), named(text_col).alias("text"))
    order = [F.col(c).asc_nulls_first() for c in ("tree", "turn", "role", "text")]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = stored(picked.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                    .withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()))
    here = Window.partitionBy("part").orderBy("row")
    # Only the narrow columns are ordered again; a part is one range partition.
    narrow = ranged.select("tree", "part", "row").withColumns({"back": F.lag("row").over(here), "back_tree": F.lag(F.struct("tree")).over(here)})
    last = Window.orderBy("part")
    ends = ranged.groupBy("part").agg(F.max_by(F.struct("tree", "row"), "row").alias("end"))  # one row for each partition
    carried = ends.select(F.lead("part").over(last).alias("part"), F.col("end").alias("carry")).filter("part IS NOT NULL")
    met = narrow.join(F.broadcast(carried), "part", "left")
    before = F.coalesce(F.when(F.col("back").isNotNull(), F.struct(F.col("back_tree.tree").alias("tree"), F.col("back").alias("row"))), F.col("carry"))
    linked = met.withColumn("before", before).select(
        "row", F.when(F.col("before").isNotNull() & F.col("before.tree").eqNullSafe(F.col("tree")), F.col("before.row")).alias("parent"))
    return ranged.join(linked, "row").select("tree", F.col("row").alias("node"), "parent", F.lit(0.0).alias("score"), "role", "text")


def jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Levels (node, up, score, steps), level k looking up to 2**k replies further, and (node, score, steps) up to the root.

    `up` is the node reached, `score` and `steps` add up what was passed.  A node that has reached its root is settled and
    takes no part in further rounds but as a target.  Nodes on a cycle never settle; the rounds end when they would exceed
    the length of any path.
    """
    first = stored(nodes.select("node", F.col("parent").alias("up"), "score", F.lit(1).cast("long").alias("steps")))
    settled, active = first.filter("up IS NULL").drop("up"), first.filter("up IS NOT NULL")
    levels, most = [active], max(1, nodes.count()).bit_length() + 1
    while not active.isEmpty() and len(levels) <= most:
        targets = active.select(F.col("node").alias("up"), F.col("up").alias("further"), F.col("score").alias("more"), F.col("steps").alias("passed")).unionByName(
            settled.select(F.col("node").alias("up"), F.lit(None).cast(first.schema["up"].dataType).alias("further"), F.col("score").alias("more"), F.col("steps").alias("passed")))
        moved = stored(active.join(targets, "up").select(
            "node", F.col("further").alias("up"), (F.col("score") + F.col("more")).alias("score"), (F.col("steps") + F.col("passed")).alias("steps")))
        settled, active = settled.unionByName(moved.filter("up IS NULL").drop("up")), moved.filter("up IS NOT NULL")
        levels.append(active)
    return levels, settled


def chosen_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, branch, depth, node, role, text): the messages on the `branches` best root-to-leaf paths of every tree.

    `messages` has (tree, node, parent, score, role, text); a path's score is the sum over its messages, ties go to the
    longer path, then to the smaller leaf.  A parent that is missing or absent from the table makes a root; a missing score
    counts zero.  A message replying to itself through others has no root and is on no path.  Rows repeating a node are one
    message, the smallest by (role, text).
    """
    rows = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), "role", "text").filter("node IS NOT NULL")
    first = rows.groupBy("node").agg(F.min(F.struct("role", "text", "tree", "parent", "score")).alias("m")).select("node", "m.*")
    known = first.select(F.col("node").alias("parent"), F.lit(True).alias("there"))
    replies = first.filter("parent IS NOT NULL").join(known, "parent", "left").withColumn("parent", F.when(F.col("there"), F.col("parent"))).drop("there")
    nodes = stored(replies.unionByName(first.filter("parent IS NULL")))  # roots need no look-up
    levels, top = jumps(nodes)
    replied = nodes.select(F.col("parent").alias("node")).filter("node IS NOT NULL").distinct()
    leaves = nodes.select("tree", "node").join(replied, "node", "left_anti").join(top.select("node", "score", "steps"), "node")
    best = F.struct((-F.col("score")).alias("less"), (-F.col("steps")).alias("shorter"), F.col("node").alias("leaf"))
    if branches == 1:
        picked = leaves.groupBy("tree").agg(F.min(best).alias("b")).select("tree", F.lit(1).alias("branch"), "b.leaf")
    else:
        rank = F.row_number().over(Window.partitionBy("tree").orderBy(best))
        picked = leaves.withColumn("branch", rank).filter(F.col("branch") <= branches).select("tree", "branch", F.col("node").alias("leaf"))
    on_path = picked.select("tree", "branch", F.col("leaf").alias("node"))
    for level in reversed(levels):  # each level adds, for every message found, the one 2**k replies up
        up = on_path.join(level.select("node", "up"), "node").select("tree", "branch", F.col("up").alias("node"))
        on_path = stored(on_path.unionByName(up).distinct())
    depth = top.select("node", F.col("steps").alias("depth"))
    return on_path.join(depth, "node").join(nodes.select("node", "role", "text"), "node").select("tree", "branch", "depth", "node", "role", "text")


def formatted(paths: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(tree, branch, formatted, loss): each path as one text, and the spans (start, length, in code points) to learn from.

    A turn is "### role:", a line feed, the escaped text and "</turn>"; a NULL role or text is empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(TURN), escaped(role, ROLE_ESCAPES), F.lit(AFTER_ROLE))
    parts = paths.select("tree", "branch", "depth", head.alias("head"), escaped(text).alias("body"), (role == loss_role).alias("learn"))
    size = F.char_length("head") + F.char_length("body") + len(END_TURN)
    before = Window.partitionBy("tree", "branch").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("start", (F.coalesce(F.sum(size).over(before), F.lit(0)) + F.char_length("head")).cast("long"))
    turns = placed.groupBy("tree", "branch").agg(F.array_sort(F.collect_list(F.struct("depth", "head", "body", "learn", "start"))).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END_TURN))), "")
    spans = F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["start"].alias("start"), F.char_length(t["body"]).cast("long").alias("length")))
    return turns.select("tree", "branch", whole.alias("formatted"), spans.alias("loss"))


def learned(text: Column, loss: Column) -> Column:
    """The original text under the loss spans of a formatted text, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def read_back(text: Column) -> Column:
    """The turns array<struct<role, text>> of a formatted text."""
    parts = F.filter(F.split(text, END_TURN, -1), lambda p: p != "")
    def turn(p: Column) -> Column:
        body = F.substring(p, F.lit(len(TURN) + 1), F.char_length(p))
        cut = F.instr(body, AFTER_ROLE)
        return F.struct(unescaped(F.substring(body, F.lit(1), cut - 1), ROLE_ESCAPES).alias("role"), unescaped(F.substring(body, cut + len(AFTER_ROLE), F.char_length(body))).alias("text"))

    return F.transform(parts, turn)

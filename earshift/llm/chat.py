"""Chat formatting of reply trees.

Root-to-leaf paths come from iterative self-joins that double their reach: the
table of ancestors 2**k steps up, joined with itself, gives the one for the next
round, and joined with the paths so far doubles their length.  Branches are
ranked by score and each chosen path becomes one conversation.

Template: ``<turn:ROLE>`` newline text ``</turn>`` newline.  In roles and texts
``\\`` stands as ``\\b``, ``<`` as ``\\l`` and ``>`` as ``\\g``, so no text holds
a control string and the change is undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialise, work_dir

ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
END = "</turn>\n"


def escape(c: Column) -> Column:
    for plain, coded in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def chains(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns in a row as trees of one branch: tree, node, parent, role, text, score.
    Null turns come first; rows of the same turn go by role and text."""
    w = Window.partitionBy("tree").orderBy(*[F.col(c).asc_nulls_first() for c in ("_t", "role", "text")])
    r = rows.select(F.col(f"`{conv}`").alias("tree"), F.col(f"`{turn}`").alias("_t"),
                    F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    r = r.withColumn("node", F.row_number().over(w).cast("long"))
    return r.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text",
                    F.lit(0.0).alias("score"))


def branches(nodes: DataFrame, base: str, top: int | None = None) -> DataFrame:
    """Paths of a written table (uid, up, tree, score): leaf, uid, dist (steps above the leaf).

    ``top`` keeps the best branches of a tree by the sum of their scores, the
    smaller leaf first among equals.
    """
    up = nodes.where("up is not null").select("uid", "up")
    inner = up.select(F.col("up").alias("uid")).distinct()
    paths = materialise(nodes.join(inner, "uid", "left_anti").select(
        F.col("uid").alias("leaf"), "uid", F.lit(0).cast("long").alias("dist")), "paths0", base)
    most, k = nodes.count(), 0
    while not up.isEmpty():
        if 1 << k > most:
            raise ValueError("a row is its own ancestor")
        step = up.select(F.col("uid").alias("_u"), F.col("up").alias("_up"))
        above = paths.join(step, F.col("uid") == F.col("_u")).select("leaf", F.col("_up").alias("uid"), (F.col("dist") + (1 << k)).alias("dist"))
        paths = materialise(paths.unionByName(above), f"paths{k + 1}", base)
        up = materialise(up.join(step, F.col("up") == F.col("_u")).select("uid", F.col("_up").alias("up")), f"up{k + 1}", base)
        k += 1
    if top is None:
        return paths
    scored = paths.join(nodes.select("uid", "score"), "uid").groupBy("leaf").agg(F.sum("score").alias("score"))
    w = Window.partitionBy("tree").orderBy(F.desc_nulls_last("score"), "node", "leaf")
    best = scored.join(nodes.select(F.col("uid").alias("leaf"), "tree", "node"), "leaf").withColumn(
        "_n", F.row_number().over(w)).where(F.col("_n") <= top).select("leaf")
    return paths.join(best, "leaf", "left_semi")


def format_paths(nodes: DataFrame, learn: str = "assistant", top: int | None = None) -> DataFrame:
    """tree, leaf, formatted and loss_spans (byte ranges of the texts to learn),
    one row per chosen path.

    ``nodes``: tree, node, parent, role, text, score.  A parent that is null or
    not there makes a root; nodes that repeat a key make a path each with the
    children of all of them; null roles and texts count as empty, null scores as
    0, a null tree is a tree of its own.  An empty table gives an empty one;
    further columns are ignored.  A cycle raises.
    """
    base = work_dir(nodes.sparkSession)
    n = materialise(nodes.select(F.monotonically_increasing_id().alias("uid"), "tree", "node", "parent",
                                 F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
                                 F.coalesce("score", F.lit(0.0)).alias("score")), "nodes", base)
    p = n.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("uid").alias("up"))
    linked = materialise(n.select("uid", "tree", "node", "parent", "score").join(
        p, n["tree"].eqNullSafe(F.col("_t")) & (F.col("parent") == F.col("_n")), "left").select(
        "uid", "up", "tree", "node", "score"), "linked", base)
    paths = branches(linked, base, top)
    head = F.concat(F.lit("<turn:"), escape(F.col("role")), F.lit(">\n"))
    rows = paths.join(n.select("uid", "tree", "role", "text"), "uid").select(
        "tree", "leaf", "dist", (F.col("role") == learn).alias("learn"), head.alias("head"), escape(F.col("text")).alias("body"))
    rows = rows.withColumn("n", F.octet_length("head") + F.octet_length("body") + len(END))
    w = Window.partitionBy("leaf").orderBy(F.desc("dist")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("n").over(w), F.lit(0)) + F.octet_length("head"))
    parts = F.sort_array(F.collect_list(F.struct(
        (-F.col("dist")).alias("o"), F.concat("head", "body", F.lit(END)).alias("s"), "learn", "at",
        (F.col("at") + F.octet_length("body")).alias("end"))))
    g = rows.groupBy("leaf").agg(F.first("tree").alias("tree"), parts.alias("_p"))
    return g.select("tree", "leaf", F.array_join(F.transform("_p", lambda x: x["s"]), "").alias("formatted"),
                    F.transform(F.filter("_p", lambda x: x["learn"]), lambda x: F.struct(
                        x["at"].alias("start"), x["end"].alias("end"))).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (role, text) and loss_text, both unescaped, read from the output alone."""
    # a generator's output: the bytes are made once, not for every span
    f = formatted.select("*", F.inline(F.array(F.struct(
        F.encode("formatted", "UTF-8").alias("_bytes"), F.split("formatted", "</turn>\n").alias("_turns")))))
    turn = lambda x: F.struct(
        unescape(F.substring_index(F.substring(x, 7, 1 << 30), ">", 1)).alias("role"),
        unescape(F.substr(x, F.length(F.substring_index(x, ">", 1)) + 3)).alias("text"))
    spans = F.transform("loss_spans", lambda s: F.decode(
        F.substr("_bytes", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), "UTF-8"))
    return f.select(*formatted.columns, F.transform(F.filter("_turns", lambda x: x != ""), turn).alias("turns"),
                    unescape(F.array_join(spans, "")).alias("loss_text"))

"""Chat formatting: reply trees become conversations, in one reversible template.

Messages point to the message they answer.  Self-joins that double their reach carry the
sum of the scores, the number of messages and the root along, one row per message, in as
many rounds as the depth has binary digits.  The leaves of each tree are ranked by the mean
score of their path; only the chosen paths are then expanded, by the same tables, and each is
written as one conversation.  All of it is DataFrame functions.

Control strings inside roles and texts are broken by an escape character after their
first character; the escape character itself is doubled.  So a formatted conversation
holds a control string only where the template put it, and nothing is lost.

Null roles and texts are empty.  A message with a null id is a message like any other, to
which nothing can reply, as a null parent is none.  Rows that reply to a message that is not
there begin a tree; a cycle of replies reaches no root and gives no conversation; of several
rows with one id the whole row of the smallest (parent, role, text, score) counts.  A null
score counts as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden.llm.store import stored

START, MID, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of the public chat templates.
CONTROL = (START, MID, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "\\"


def escaped(c: Column) -> Column:
    c = F.replace(F.coalesce(c, F.lit("")), F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for s in CONTROL:
        c = F.replace(c, F.lit(s), F.lit(s[0] + ESCAPE + s[1:]))
    return c


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def single(messages: DataFrame) -> DataFrame:
    """n, id, parent, role, text, score: one whole row per id, numbered; stored.

    The joins that follow are over the numbers: narrow, and never null.
    """
    rest = ("parent", "role", "text", "score")
    have = [F.col(c) if c in messages.columns else F.lit(None).cast("string").alias(c) for c in rest]
    one = messages.select("id", *have).groupBy("id").agg(F.min(F.struct(*rest)).alias("m")).select("id", "m.*")
    return stored(one.withColumn("n", F.monotonically_increasing_id()), "replies")


def ancestors(nodes: DataFrame) -> list[DataFrame]:
    """Tables (n, up, root, many, total), one per round, stored.

    In round k ``many`` messages from n upwards have been added up, 2**k of them or all up to the
    root.  ``up`` is the next one; where there is none, ``root`` is known.
    """
    at = nodes.select(F.col("id").alias("__id"), F.col("n").alias("up"))
    first = nodes.join(at, nodes["parent"] == at["__id"], "left")
    root = F.when(F.col("up").isNull(), F.col("n"))
    total = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    tables = [stored(first.select("n", "up", root.alias("root"), F.lit(1).cast("long").alias("many"), total.alias("total")), "replies-up")]
    while True:
        now = tables[-1]
        open_ = now.filter("up IS NOT NULL").alias("a")
        above = now.alias("b")
        step = open_.join(above, F.col("a.up") == F.col("b.n")).select(
            "a.n", "b.up", "b.root", (F.col("a.many") + F.col("b.many")).alias("many"), (F.col("a.total") + F.col("b.total")).alias("total")
        )
        step = stored(step.unionByName(now.filter("up IS NULL")), "replies-up")
        # depths have no gaps: a round that ends no path is the last; what is open lies on or below a cycle
        if step.filter("up IS NULL").count() == now.filter("up IS NULL").count():
            return tables
        tables.append(step)


def best_paths(nodes: DataFrame, best: int) -> DataFrame:
    """The best paths of every tree: root, leaf, path_rank, path_score, step, n; numbers of messages."""
    tables = ancestors(nodes)
    replied = tables[0].filter("up IS NOT NULL").select(F.col("up").alias("n")).distinct()
    ends = tables[-1].filter("up IS NULL").join(replied, "n", "left_anti").join(nodes.select("n", "id"), "n")
    ends = ends.select("root", F.col("n").alias("leaf"), "id", "many", (F.col("total") / F.col("many")).alias("path_score"))
    order = Window.partitionBy("root").orderBy(F.desc("path_score"), "id")
    # Spark keeps the best few of a tree in every task before they are shuffled
    chosen = ends.withColumn("path_rank", F.row_number().over(order)).filter(F.col("path_rank") <= best)
    chosen = stored(chosen.drop("id"), "replies-chosen")
    steps = chosen.select("leaf", F.col("leaf").alias("n"), F.lit(0).cast("long").alias("back"))
    for k in reversed(range(len(tables))):
        up = tables[k].filter("up IS NOT NULL").select(F.col("n").alias("at"), "up")
        above = steps.join(up, steps["n"] == up["at"]).select("leaf", F.col("up").alias("n"), (F.col("back") + 2**k).alias("back"))
        # written in every round: the next one reads it twice
        steps = stored(steps.unionByName(above), "replies-steps")
    return steps.join(chosen, "leaf").select(
        "root", "leaf", "path_rank", "path_score", (F.col("many") - 1 - F.col("back")).alias("step"), "n"
    )


def reply_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """The best root-to-leaf paths of every tree: root, leaf, path_rank, path_score, step, id.

    ``messages``: id, parent, score.  A path scores the mean of its messages; ties go to
    the smaller leaf.  ``step`` counts from 0 at the root.
    """
    nodes = single(messages)
    paths = best_paths(nodes, best)
    for end in ("root", "leaf", "n"):
        named = nodes.select(F.col("n").alias("__at"), F.col("id").alias(f"__{end}"))
        paths = paths.join(named, F.col(end) == F.col("__at")).drop("__at")
    return paths.select(F.col("__root").alias("root"), F.col("__leaf").alias("leaf"), "path_rank", "path_score", "step", F.col("__n").alias("id"))


def formatted(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """One conversation per path: root, leaf, path_rank, path_score, formatted, loss.

    ``loss`` lists the spans (code points, end exclusive) of the assistant texts in
    ``formatted``: the mask under which a model is trained.
    """
    said = paths.join(nodes.select("n", "id", "role", "text"), "n")
    head = F.concat(F.lit(START), escaped(F.col("role")), F.lit(MID))
    said = said.select(
        "leaf", "path_rank", "path_score", "step", "id", head.alias("head"), escaped(F.col("text")).alias("body"),
        F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("learn"),
    )
    before = Window.partitionBy("leaf").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long_ = F.length("head") + F.length("body") + len(END)
    start = F.coalesce(F.sum(long_).over(before), F.lit(0)) + F.length("head")
    said = said.withColumn("start", start.cast("long"))
    turn = F.struct(
        "step", "learn", "start", (F.col("start") + F.length("body")).alias("end"),
        F.concat("head", "body", F.lit(END)).alias("turn"),
    )
    boxed = F.struct("id")
    whole = said.groupBy("leaf").agg(
        F.min_by(boxed, "step").alias("root"), F.max_by(boxed, "step").alias("last"), F.min("path_rank").alias("path_rank"),
        F.min("path_score").alias("path_score"), F.sort_array(F.collect_list(turn)).alias("t"),
    )
    spans = F.transform(F.filter("t", lambda t: t["learn"]), lambda t: F.struct(t["start"], t["end"]))
    return whole.select(
        F.col("root.id").alias("root"), F.col("last.id").alias("leaf"), "path_rank", "path_score",
        F.array_join(F.transform("t", lambda t: t["turn"]), "").alias("formatted"), spans.alias("loss"),
    )


def chains(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """A table of turns as messages: every row replies to the one before it in its conversation.

    Columns id, parent, score, role, text; the id holds the conversation.  Ties of the turn
    go by role, then text.
    """
    rows = turns.select(
        F.col(conversation).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    )
    n = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text"))
    rows = rows.withColumn("n", n)
    at = lambda i: F.struct(F.col("conv"), i.alias("n"))
    parent = F.when(F.col("n") > 1, at(F.col("n") - 1))
    return rows.select(at(F.col("n")).alias("id"), parent.alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def read_back(conversations: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text) and ``loss_text``, read from the formatted text alone."""
    parts = F.split("formatted", r"\Q" + END + r"\E")
    parts = F.filter(parts, lambda p: p != "")
    pair = F.transform(parts, lambda p: F.split(F.substring(p, len(START) + 1, 1 << 30), r"\Q" + MID + r"\E", 2))
    turns = F.transform(pair, lambda p: F.struct(unescaped(p[0]).alias("role"), unescaped(p[1]).alias("text")))
    learnt = F.transform(
        "loss",
        lambda s: unescaped(F.col("formatted").substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))),
    )
    return conversations.withColumn("turns", turns).withColumn("loss_text", F.array_join(learnt, ""))


def chat_conversations(messages: DataFrame, best: int = 1) -> DataFrame:
    """The best paths of all reply trees, formatted.  ``messages``: id, parent, score, role, text."""
    nodes = single(messages)
    return formatted(best_paths(nodes, best), nodes)

r"""Chat formatting over reply trees [native].

Messages form trees through their parent ids. Self-joins that double their reach
(parents, grandparents, the fourth, the eighth ...) give every leaf the score of
its branch, branches are ranked inside their conversation, and the same jumps
then enumerate the messages of the chosen root-to-leaf paths. A tree of
depth d takes about log2(d) joins.

A path becomes one text: ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a newline per turn.
Inside roles and texts a backslash is doubled, and a backslash is put
behind the first character of ``<|``, ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]``,
so control strings occur only where the template has them and texts come back exactly.

Defined cases: a null role or text is empty, a null score 0; a parent that is not
there makes its message a root; messages on or behind a cycle have no
root and are in no path; a message that repeats its id is a branch of its
own only if the caller gives it an id; a null conversation id is one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitesift.llm.shared import durable

# Marks of the template.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
LEARNT_ROLE = "assistant"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"([<\[])((?<=<)(?:\||/?s>)|(?<=\[)/?INST\])", r"$1\\$2")


def unescape(text: Column) -> Column:
    plain = F.regexp_replace(text, r"([<\[])\\((?<=<\\)(?:\||/?s>)|(?<=\[\\)/?INST\])", "$1$2")
    return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


def chosen_paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """(conv_id, leaf, place, msg_id, rank): the messages of each chosen path from its root on.

    ``messages`` has conv_id, msg_id, parent_id and score. ``branches`` keeps
    the best paths of a conversation by summed score, ties by the smaller leaf.
    """
    nodes = durable(messages.select(
        "conv_id", "msg_id", "parent_id", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")))
    parents = nodes.select(F.col("conv_id").alias("c"), F.col("msg_id").alias("p"), F.col("score").alias("more"))
    # A jump: from a message to the ancestor ``reach`` steps above, with the score gathered on the way.
    jump = durable(nodes.join(parents, F.expr("conv_id <=> c AND parent_id = p")).select(
        "conv_id", "msg_id", F.col("p").alias("above"), F.col("more").alias("gained")))
    linked = nodes.join(jump.select(F.col("conv_id").alias("c"), F.col("above").alias("m")).distinct(),
                        F.expr("conv_id <=> c AND msg_id = m"), "left_anti")
    ends = linked.select("conv_id", F.col("msg_id").alias("leaf"), F.col("msg_id").alias("top"), "score",
                         F.lit(0).cast("long").alias("depth"))
    jumps, most, reach = [], nodes.count(), 1
    while reach <= most and not jump.isEmpty():
        jumps.append((reach, jump))
        far = jump.select(F.col("conv_id").alias("c"), F.col("msg_id").alias("via"), F.col("above").alias("over"),
                          F.col("gained").alias("more"))
        jump = durable(jump.join(far, F.expr("conv_id <=> c AND above = via")).select(
            "conv_id", "msg_id", F.col("over").alias("above"), (F.col("gained") + F.col("more")).alias("gained")))
        reach *= 2

    def steps(reach: int, jump: DataFrame) -> DataFrame:
        return jump.select(F.col("conv_id").alias("c"), F.col("msg_id").alias("via"), F.col("above").alias("over"),
                           F.col("gained").alias("more"), F.lit(reach).cast("long").alias("reach"))

    ends = durable(ends)
    for reach, jump in reversed(jumps):  # climb to the root by the binary digits of the depth
        ends = ends.join(steps(reach, jump), F.expr("conv_id <=> c AND top = via"), "left").select(
            "conv_id", "leaf", F.coalesce("over", "top").alias("top"),
            (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
            (F.col("depth") + F.coalesce("reach", F.lit(0))).alias("depth"))
    orphan = nodes.join(parents, F.expr("conv_id <=> c AND parent_id = p"), "left_anti").select(
        F.col("conv_id").alias("c"), F.col("msg_id").alias("m"))
    ends = ends.join(orphan, F.expr("conv_id <=> c AND top = m"), "left_semi")
    order = W.partitionBy("conv_id").orderBy(F.desc("score"), "leaf")
    ranked = ends.withColumn("rank", F.row_number().over(order))
    if branches is not None:
        ranked = ranked.where(F.col("rank") <= branches)
    path = durable(ranked.select("conv_id", "leaf", "rank", F.col("leaf").alias("msg_id"), F.col("depth").alias("place")))
    for reach, jump in reversed(jumps):  # every ancestor is a sum of distinct jumps
        further = path.join(steps(reach, jump), F.expr("conv_id <=> c AND msg_id = via")).select(
            "conv_id", "leaf", "rank", F.col("over").alias("msg_id"), (F.col("place") - reach).alias("place"))
        path = durable(path.union(further))  # else each round would double the plan
    return path


def formatted(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """(conv_id, leaf, rank, formatted, loss): one text per chosen path.

    ``loss`` lists start (code points from 0) and length of each learnt text.
    """
    pieces = messages.select(
        F.col("conv_id").alias("c"), F.col("msg_id").alias("m"),
        escape(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"),
        (F.col("role") == LEARNT_ROLE).alias("learnt"))
    path = chosen_paths(messages, branches)
    turns = path.join(pieces, F.expr("conv_id <=> c AND msg_id = m")).select(
        "conv_id", "leaf", "rank", "place", "text", F.concat(F.lit(START), "role", F.lit(SEP)).alias("head"), "learnt")
    along = W.partitionBy("conv_id", "leaf", "rank").orderBy("place")
    whole = F.length("head") + F.length("text") + len(END)
    turns = turns.withColumn("start", F.sum(whole).over(along) - F.length("text") - len(END))
    return turns.groupBy("conv_id", "leaf", "rank").agg(
        F.array_sort(F.collect_list(F.struct("place", F.concat("head", "text", F.lit(END)).alias("piece")))).alias("pieces"),
        F.array_sort(F.collect_list(F.when(F.col("learnt"), F.struct(
            F.col("start"), F.length("text").alias("length"))))).alias("loss"),
    ).select("conv_id", "leaf", "rank", F.array_join("pieces.piece", "").alias("formatted"), "loss")


def read_back(texts: DataFrame) -> DataFrame:
    """Adds turns (array of role, text) and learnt (texts under the mask), both unescaped."""
    parts = F.split("formatted", r"<\|im_end\|>\n")
    body = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.substr(x, F.lit(len(START) + 1)))
    turns = F.transform(body, lambda x: F.struct(
        unescape(F.substring_index(x, SEP, 1)).alias("role"),
        unescape(F.substr(x, F.length(F.substring_index(x, SEP, 1)) + len(SEP) + 1)).alias("text")))
    learnt = F.transform("loss", lambda s: unescape(F.substr(
        F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return texts.withColumns({"turns": turns, "learnt": learnt})


def conversation_digest(conversations: DataFrame) -> DataFrame:
    """Digest of every conversation, read back from its formatted text."""
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    messages = durable(conversations.select("conv_id", "role", "text", "turn").withColumn("msg_id", place)).select(
        "conv_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text",
        F.lit(0.0).alias("score"))
    back = read_back(formatted(messages))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("learnt", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))

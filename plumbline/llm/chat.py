"""Chat formatting of reply trees.

Messages point to the message they answer. Iterative self-joins double the pointers of every message (after k rounds a
pointer reaches 2^k messages up and carries how many messages and how much score lie between), so a chain of any length
takes a logarithmic number of joins. Leaves then know the length and score of their path; the best leaves of a tree are
chosen, their paths are walked down again through the same pointers, and each path is formatted as one conversation.

The template marks turns with control strings. In a text (or role) that holds one of them a backslash is put behind its
first character, and backslashes are doubled, so a text can never end a turn and everything can be read back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import keep

BEGIN, END = "<s>", "</s>"
USER, USER_END = "[INST]", "[/INST]"
ASSISTANT = "[ASST]"
ROLE, TEXT, ROLE_END = "[ROLE]", "[TEXT]", "[/ROLE]"
CONTROL = re.compile("|".join(map(re.escape, (BEGIN, END, USER, USER_END, ASSISTANT, ROLE, TEXT, ROLE_END))))
ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one string, and the character ranges that bear loss: the texts of assistant turns."""
    parts, loss, at = [BEGIN], [], len(BEGIN)
    for role, text in turns:
        body = escape(text)
        if role == "user":
            new = [f"{USER} ", body, f" {USER_END}"]
        elif role == "assistant":
            new = [f"{ASSISTANT} ", body, f" {END}"]
            loss.append((at + len(new[0]), at + len(new[0]) + len(body)))
        else:
            new = [f"{ROLE} {escape(role)} {TEXT} ", body, f" {ROLE_END}"]
        parts += new
        at += sum(map(len, new))
    return "".join(parts), loss


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation, as they were before escaping."""
    if not formatted.startswith(BEGIN):
        raise ValueError("not a formatted conversation")
    turns, at = [], len(BEGIN)

    def until(mark: str, begin: int) -> tuple[str, int]:
        end = formatted.index(" " + mark, begin)
        return unescape(formatted[begin:end]), end + 1 + len(mark)

    while at < len(formatted):
        if formatted.startswith(USER + " ", at):
            text, at = until(USER_END, at + len(USER) + 1)
            turns.append(("user", text))
        elif formatted.startswith(ASSISTANT + " ", at):
            text, at = until(END, at + len(ASSISTANT) + 1)
            turns.append(("assistant", text))
        elif formatted.startswith(ROLE + " ", at):
            role, at = until(TEXT, at + len(ROLE) + 1)
            text, at = until(ROLE_END, at + 1)
            turns.append((role, text))
        else:
            raise ValueError(f"no turn begins at {at}")
    return turns


def best_paths(messages: DataFrame, *, tree: str, message: str, parent: str, score: str, branches: int = 1) -> DataFrame:
    """Rows (tree, leaf, place, message) of the chosen root-to-leaf paths, place counting from 0 at the root.

    Paths rank by mean score of their messages, then by length, then by the smallest leaf. A message whose parent is null
    or missing is a root. Messages in a cycle of parents, and those below one, lie on no path. Rows with a null tree or
    message are left out, of repeated (tree, message) rows one stays, a null score is 0.
    """
    nodes = (messages.where(F.col(tree).isNotNull() & F.col(message).isNotNull())
             .groupBy(F.col(tree).alias("tree"), F.col(message).alias("id")).agg(F.min(F.struct(F.col(parent).alias("up"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score"))).alias("n"))
             .select("tree", "id", "n.up", "n.score"))
    known = nodes.select("tree", F.col("id").alias("up"), F.lit(True).alias("there"))
    # A message whose pointer has passed the root is finished; only the others are joined again.
    step = keep(nodes.join(known, ["tree", "up"], "left").select("tree", "id", F.when(F.col("there"), F.col("up")).alias("up"), F.lit(1).cast("long").alias("n"), "score"), "reply-jumps")
    whole, jumps, most = step.where(F.col("up").isNull()), [step.where(F.col("up").isNotNull())], step.count()
    while not jumps[-1].isEmpty() and (1 << len(jumps) - 1) <= most:
        further = jumps[-1].unionByName(whole).select("tree", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("n").alias("n2"), F.col("score").alias("score2"))
        step = keep(jumps[-1].join(further, ["tree", "up"]).select("tree", "id", F.col("up2").alias("up"), (F.col("n") + F.col("n2")).alias("n"), (F.col("score") + F.col("score2")).alias("score")), "reply-jumps")
        whole = whole.unionByName(step.where(F.col("up").isNull()))
        jumps.append(step.where(F.col("up").isNotNull()))
    inner = jumps[0].select("tree", F.col("up").alias("id")).distinct()
    leaves = whole.join(inner, ["tree", "id"], "left_anti").withColumn("mean", F.col("score") / F.col("n"))
    if branches == 1:
        chosen = leaves.groupBy("tree").agg(F.min(F.struct(-F.col("mean"), -F.col("n"), "id", "n")).alias("best")).select("tree", F.col("best.id").alias("leaf"), F.col("best.n").alias("n"))
    else:
        order = Window.partitionBy("tree").orderBy(F.desc("mean"), F.desc("n"), "id")
        chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches).select("tree", F.col("id").alias("leaf"), "n")
    path = chosen.select("tree", "leaf", F.col("leaf").alias("id"), (F.col("n") - 1).alias("place"))
    for k in range(len(jumps) - 1, -1, -1):
        path = keep(path.unionByName(path.join(jumps[k].select("tree", "id", "up", "n"), ["tree", "id"]).select("tree", "leaf", F.col("up").alias("id"), (F.col("place") - F.col("n")).alias("place"))), "reply-paths")
    return path.select("tree", "leaf", "place", F.col("id").alias("message"))


def format_trees(messages: DataFrame, *, tree: str, message: str, parent: str, role: str, text: str, score: str, branches: int = 1) -> DataFrame:
    """One row per chosen path: tree, leaf, n_turns, formatted, loss array<struct<start, end>> in characters.

    Null role or text: empty. Of repeated (tree, message) rows the smallest (role, text) is used. An empty table gives none.
    """
    names = {tree: "tree", message: "message"}
    paths = best_paths(messages, tree=tree, message=message, parent=parent, score=score, branches=branches)
    texts = (messages.select(F.col(tree).alias("tree"), F.col(message).alias("message"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
             .groupBy(*names.values()).agg(F.min(F.struct("role", "text")).alias("turn")))
    rows = (paths.join(texts, ["tree", "message"]).select("tree", "leaf", "place", "turn.role", "turn.text")
            .repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "place"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, turns, done, types = None, [], [], None

        def out() -> pa.RecordBatch:
            made = [format_turns(t) for _, t in done]
            batch = pa.RecordBatch.from_arrays([
                pa.array([k[0] for k, _ in done], types[0]), pa.array([k[1] for k, _ in done], types[1]), pa.array([len(t) for _, t in done], pa.int64()),
                pa.array([m[0] for m in made], pa.string()), pa.array([[{"start": a, "end": b} for a, b in m[1]] for m in made], span)], ["tree", "leaf", "n_turns", "formatted", "loss"])
            done.clear()
            return batch

        for batch in batches:
            types = batch.schema.field("tree").type, batch.schema.field("leaf").type
            for t, leaf, r, x in zip(*(batch[c].to_pylist() for c in ("tree", "leaf", "role", "text")), strict=True):
                if (t, leaf) != key:
                    if key:
                        done.append((key, turns))
                    key, turns = (t, leaf), []
                    if len(done) >= 500:
                        yield out()
                turns.append((r, x))
        if key:
            done.append((key, turns))
        if done:
            yield out()

    schema = T.StructType([rows.schema["tree"], rows.schema["leaf"], T.StructField("n_turns", T.LongType()), T.StructField("formatted", T.StringType()),
                           T.StructField("loss", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    return rows.mapInArrow(run, schema)


def as_trees(rows: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations given as numbered turns, as reply trees with one path each: every turn answers the one before.

    Turns with one number go by role, then text. Rows with a null conversation are left out.
    """
    order = Window.partitionBy("tree").orderBy(F.col(turn).asc_nulls_first(), F.col(role).asc_nulls_first(), F.col(text).asc_nulls_first())
    numbered = rows.where(F.col(conversation).isNotNull()).withColumnRenamed(conversation, "tree").withColumn("message", F.row_number().over(order).cast("long"))
    return numbered.select("tree", "message", F.when(F.col("message") > 1, F.col("message") - 1).alias("parent"), F.col(role).alias("role"), F.col(text).alias("text"), F.lit(0.0).alias("score"))

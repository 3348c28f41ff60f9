"""Chat text from reply trees: root-to-leaf paths by self-joins, branches by score, one conversation each.

A message names the message it answers.  Joining the table of jumps with itself doubles a jump's
length, so after log2(depth) joins every leaf knows its root and the sum of scores on the way.  The
best branches of every tree are chosen from these sums, and only their paths are enumerated, again by
joins with the jumps.  A conversation of any length is so spread by message over all tasks.

A path is written as one row per turn, in order.  A conversation's text is its turns' texts one after
the other:

    ### role:\\n text \\n</turn>\\n

(without the blanks).  Inside roles and texts a backslash becomes two, "###" becomes backslash h and
"</turn>" backslash t; in roles ":" becomes backslash c and a line feed backslash n.  So no text can
look like a mark, and a single pass restores it.  The loss mask is the span of an assistant's text, in code
points of the turn's formatted text.

Reading back streams turns in order and keeps one running hash, never a whole conversation.  A hash
over one conversation is sequential, so that one step reads a conversation in one task.

Defined results: a null text or role is empty; a message whose parent isn't there, or is itself, is a
root; messages with equal conversation and node are one, the smallest by role and text; messages on
or below a cycle of parents have no root and belong to no path; equal scores go to the smaller leaf; in
linear conversations rows go by turn (null first), ties by role and text; a null ``conv_id`` is a
conversation of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausetrail.llm.common import prepare, stage

ASSISTANT = "assistant"
# The marks of the template and what stands for them inside texts.
ESCAPES = {"\\": "\\\\", "###": "\\h", "</turn>": "\\t"}
ROLE_ESCAPES = {":": "\\c", "\n": "\\n"}
_BACK = {"\\": "\\", "h": "###", "t": "</turn>", "c": ":", "n": "\n"}
_TURN = re.compile(r"### ([^:\n]*):\n(.*)\n</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)")
DIGEST_SCHEMA = (
    "conv_id bigint, branch int, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)


def _key() -> Column:
    """The conversation as a name that isn't null."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def linear_tree(conversations: DataFrame) -> DataFrame:
    """Reply tree of conversations without branches: each row answers the one before it.

    Rows are dealt by ranges of conversation and turn and numbered in that order, so a long conversation
    spans many tasks.  The row before is the number before or, at the start of a part, the last number of the
    part before (one small row per part); the first of a conversation has no parent.
    """
    rows = conversations.select("conv_id", "turn", "role", "text", _key().alias("key"))
    order = [F.col(c).asc_nulls_first() for c in ("key", "turn", "role")]
    begins = F.substring("text", 1, 64).asc_nulls_first()  # enough to deal by, and in the order of whole texts
    dealt = rows.repartitionByRange(*order, begins).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    rows = stage(dealt.withColumn("node_id", F.monotonically_increasing_id()), "turns")
    part, inside = F.shiftright("node_id", 33), F.col("node_id").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("part")
    last = rows.groupBy(part.alias("part")).agg(F.max("node_id").alias("last"))
    last = last.select("part", F.lag("last").over(before).alias("last_before"))
    firsts = rows.groupBy("key").agg(F.min("node_id").alias("node_id")).withColumn("is_first", F.lit(True))
    placed = rows.withColumn("part", part).join(F.broadcast(last), "part").join(firsts, ["key", "node_id"], "left")
    parent = F.when(F.col("is_first"), F.lit(None)).when(inside > 0, F.col("node_id") - 1).otherwise(F.col("last_before"))
    return placed.select("conv_id", "node_id", parent.alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def _on(left: str, right: str) -> Column:
    return (F.col("a.key") == F.col("b.key")) & (F.col(f"a.{left}") == F.col(f"b.{right}"))


def jump_tables(parents: DataFrame, nodes: int) -> list[DataFrame]:
    """parents: key, node, up, gained.  Table k has the jumps over 2**k messages and the score gained."""
    tables = []
    step = stage(parents, "jumps")
    while not step.isEmpty() and 1 << len(tables) <= max(1, nodes):
        tables.append(step)
        longer = step.alias("a").join(step.alias("b"), _on("up", "node"))
        step = stage(longer.select("a.key", "a.node", "b.up", (F.col("a.gained") + F.col("b.gained")).alias("gained")), "jumps")
    return tables


def paths(tree: DataFrame, branches: int = 1) -> DataFrame:
    """tree: key, node, parent, score.  Returns key, branch, back, node of the best branches of each root.

    ``back`` counts from the leaf (0) to the root.
    """
    known = tree.select("key", F.col("node").alias("up"))
    linked = tree.filter("parent is not null and parent <> node").select("key", "node", F.col("parent").alias("up"), "score")
    linked = linked.join(known, ["key", "up"]).select("key", "node", "up", F.col("score").alias("gained"))
    tables = jump_tables(linked, tree.count())
    edges = tables[0] if tables else linked
    leaves = tree.join(edges.select("key", F.col("up").alias("node")), ["key", "node"], "left_anti")
    at = leaves.select("key", F.col("node").alias("leaf"), F.col("node").alias("at"), F.lit(0.0).alias("total"))
    for table in reversed(tables):
        met = at.alias("a").join(table.alias("b"), _on("at", "node"), "left")
        total = F.col("a.total") + F.coalesce("b.gained", F.lit(0.0))
        at = met.select("a.key", "a.leaf", F.coalesce("b.up", "a.at").alias("at"), total.alias("total"))
    roots = tree.join(edges, ["key", "node"], "left_anti").select("key", F.col("node").alias("at"), "score")
    scored = at.join(roots, ["key", "at"]).withColumn("total", F.col("total") + F.col("score"))
    order = Window.partitionBy("key", "at").orderBy(F.col("total").desc_nulls_last(), "leaf")
    chosen = scored.withColumn("branch", F.row_number().over(order)).filter(F.col("branch") <= branches)
    chosen = stage(chosen.select("key", "leaf", "branch"), "branches")
    walk = chosen.select("key", "leaf", "branch", F.col("leaf").alias("at"), F.lit(0).cast("bigint").alias("back"))
    for k, table in reversed(list(enumerate(tables))):
        met = walk.alias("a").join(table.alias("b"), _on("at", "node"), "left")
        stay = F.struct(F.col("a.at").alias("at"), F.col("a.back").alias("back"))
        jump = F.when(F.col("b.up").isNotNull(), F.struct(F.col("b.up").alias("at"), (F.col("a.back") + F.lit(1 << k)).alias("back")))
        both = F.explode(F.filter(F.array(stay, jump), lambda x: x.isNotNull()))
        walk = met.select("a.key", "a.leaf", "a.branch", both.alias("m")).select("key", "leaf", "branch", "m.at", "m.back")
    return walk.select("key", "leaf", F.col("branch").cast("int").alias("branch"), "back", F.col("at").alias("node"))


def _escaped(text: Column, escapes: dict[str, str]) -> Column:
    for mark, escape in escapes.items():
        text = F.replace(text, F.lit(mark), F.lit(escape))
    return text


def format_turns(nodes: DataFrame, branches: int = 1, distinct_nodes: bool = False) -> DataFrame:
    """nodes: conv_id, node_id, parent_id, role, text, score.  Returns one row per turn of each path.

    Columns: conv_id, leaf, branch, back (turns to the end), formatted, loss_start, loss_end.
    ``distinct_nodes`` says that no node occurs twice, which saves a pass.
    """
    prepare(nodes.sparkSession)
    content = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = nodes.select(
        _key().alias("key"),
        "conv_id",
        F.col("node_id").alias("node"),
        F.struct(content.alias("content"), F.col("parent_id").alias("parent"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score")).alias("m"),
    )
    unique = rows if distinct_nodes else rows.groupBy("key", "conv_id", "node").agg(F.min("m").alias("m"))
    messages = stage(unique.select("key", "conv_id", "node", "m.parent", "m.score", "m.content"), "messages")
    chosen = paths(messages.select("key", "node", "parent", "score"), branches)
    role, text = _escaped(F.col("content.role"), ESCAPES | ROLE_ESCAPES), _escaped(F.col("content.text"), ESCAPES)
    head = F.concat(F.lit("### "), role, F.lit(":\n"))
    start = F.char_length(head)
    loss = F.col("content.role") == ASSISTANT
    return chosen.join(messages, ["key", "node"]).select(
        "conv_id",
        "leaf",
        "branch",
        "back",
        F.concat(head, text, F.lit("\n</turn>\n")).alias("formatted"),
        F.when(loss, start).otherwise(0).alias("loss_start"),
        F.when(loss, start + F.char_length(text)).otherwise(0).alias("loss_end"),
    )


def write_turns(nodes: DataFrame, path: str, branches: int = 1, distinct_nodes: bool = False) -> None:
    """Parquet, one row per turn, dealt by ranges so that a conversation's turns stand in order."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("branch"), F.col("leaf"), F.col("back").desc()]
    format_turns(nodes, branches, distinct_nodes).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text) if "\\" in text else text


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    role, text = _TURN.fullmatch(formatted).groups()
    return unescape(role), unescape(text)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, state = None, None
    for batch in batches:
        done = []
        for conv_id, leaf, branch, formatted, start, end in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if state is None or (conv_id, leaf, branch) != own:
                if state is not None:
                    done.append((own[0], own[2], *_ended(state)))
                own, state = (conv_id, leaf, branch), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parse_turn(formatted)
            learnt = unescape(formatted[start:end])
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            state[2] += len(learnt)
            state[3].update(learnt.encode())
            state[4] += len(formatted)
        if done:
            yield _rows(done)
    if state is not None:
        yield _rows([(own[0], own[2], *_ended(state))])


def _ended(state: list) -> tuple:
    return state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]


def _rows(done: list[tuple]) -> pa.RecordBatch:
    names = [part.split()[0] for part in DIGEST_SCHEMA.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, branch and what reading the written turns of each path back gives."""
    prepare(turns.sparkSession)
    order = ["conv_id", "leaf", "branch"]
    rows = turns.select(*order, "formatted", "loss_start", "loss_end", "back")
    return rows.repartition(*order).sortWithinPartitions(*order, F.col("back").desc()).mapInArrow(_digest, DIGEST_SCHEMA)

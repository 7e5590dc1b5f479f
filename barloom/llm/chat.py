"""Chat formatting: reply trees, their root-to-leaf paths, and one text per chosen path."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import lean, whole_text
from barloom.session import store

#: The template's control strings and the role whose text is learnt.
START, END, LEARNT = "<|im_start|>", "<|im_end|>", "assistant"


def escaped(text: Column) -> Column:
    r"""`<|` becomes `<\|`, `<\|` becomes `<\\|` and so on, so no control string remains."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def escaped_role(role: Column) -> Column:
    """A role stays on one line, whatever it holds."""
    line = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return F.replace(line, F.lit("|"), F.lit("\\p"))


def replies(turns: DataFrame) -> DataFrame:
    """A plain list of turns as reply trees: each row answers the one before it.

    Columns conv_id, node, parent, role, text, score. Rows are ordered by turn (null first);
    rows of one turn by role and text. Null role or text counts as empty.
    """
    rows = lean(turns, "conv_id", "turn", "role", "text").select(
        "conv_id", "turn", whole_text("role").alias("role"), whole_text("text").alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.withColumn("node", F.row_number().over(order).cast("long")).select(
        "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text",
        F.lit(0.0).alias("score"),
    )


def paths(messages: DataFrame) -> DataFrame:
    """Root-to-leaf paths by iterative self-joins: conv_id, leaf, node, back (0 at the leaf).

    The joins double the reach: round k knows the ancestor 2^k above each node, and the paths
    found so far are prolonged by that jump, so a path of n nodes takes log2(n) rounds. Each
    round is written to the shared folder. A parent that is not among the conversation's nodes
    makes its child a root. A parent must come before its child (parent < node), which rules out
    cycles; a link that does not is cut.
    """
    links = messages.select("conv_id", "node", F.when(F.col("parent") < F.col("node"), F.col("parent")).alias("parent"))
    known = messages.select(F.col("conv_id").alias("c"), F.col("node").alias("n"))
    present = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("n"))
    jumps = store(links.join(known, present, "left").select("conv_id", "node", F.col("n").alias("up")), "chat-jumps")
    inner = jumps.select(F.col("conv_id").alias("c"), F.col("up").alias("n")).where("n is not null").distinct()
    leaves = jumps.join(inner, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")), "left_anti")
    start = leaves.select("conv_id", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back"))
    found = store(start, "chat-paths")
    jumps, reach, left = jumps.select("conv_id", "node", "up").where("up is not null"), 1, True
    while left:
        step = jumps.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), F.col("up").alias("next"))
        grown = found.join(step, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n"))).select(
            "conv_id", "leaf", F.col("next").alias("node"), (F.col("back") + reach).alias("back")
        )
        far = jumps.join(step, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("n"))).select(
            "conv_id", "node", F.col("next").alias("up")
        )
        found = store(found.unionByName(grown), "chat-paths")
        jumps, reach = store(far, "chat-jumps"), reach * 2
        left = not jumps.isEmpty()
    return found


def chosen_paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """The rows of the best paths of each conversation: conv_id, leaf, branch, back, role, text.

    A path's score is the mean score of its messages (null counts as 0). Branches are ranked by
    score, highest first, then by leaf; `branches` is how many to take, all if None.
    """
    found = paths(messages)
    said = messages.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), "role", "text", "score")
    rows = found.join(said, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")))
    rows = rows.select("conv_id", "leaf", "back", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score"))
    scores = rows.groupBy("conv_id", "leaf").agg(F.avg("score").alias("path_score"))
    rank = Window.partitionBy("conv_id").orderBy(F.desc("path_score"), "leaf")
    ranked = scores.withColumn("branch", F.row_number().over(rank))
    if branches is not None:
        ranked = ranked.where(F.col("branch") <= branches)
    ranked = ranked.select(F.col("conv_id").alias("c"), F.col("leaf").alias("l"), "branch")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("leaf") == F.col("l"))
    return rows.drop("score").join(ranked, same).drop("c", "l")


def formatted(chosen: DataFrame) -> DataFrame:
    """One text per path: conv_id, branch, formatted, loss_mask.

    A turn is START role newline text END newline; control strings inside texts are escaped.
    loss_mask holds the (start, end) code points of each learnt text in the formatted one.
    """
    pieces = chosen.select(
        "conv_id", "branch", (-F.col("back")).alias("place"), (F.col("role") == LEARNT).alias("learnt"),
        F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n")).alias("head"),
        escaped(F.col("text")).alias("body"),
    )
    tail = len(END) + 1
    so_far = Window.partitionBy("conv_id", "branch").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("head") + F.length("body") + tail).over(so_far) - tail
    turn = F.struct(
        "place", F.concat("head", "body", F.lit(END + "\n")).alias("piece"), "learnt",
        (F.col("end") - F.length("body")).alias("start"), "end",
    )
    turns = pieces.withColumn("end", end).groupBy("conv_id", "branch").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    learnt = F.filter("turns", lambda t: t["learnt"])
    return turns.select(
        "conv_id", "branch",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(learnt, lambda t: F.struct(t["start"], t["end"])).alias("loss_mask"),
    )


_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def read_turns(formatted_text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    return [(plain_role(r), plain(t)) for r, t in _TURN.findall(formatted_text)]


def plain(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def plain_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "p": "|"}.get(m[1], m[1]), role)


def digest(texts: DataFrame) -> DataFrame:
    """Read formatted texts back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    schema = T.StructType(
        [
            texts.schema["conv_id"], T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
            T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()),
            T.StructField("formatted_chars", T.LongType()),
        ]
    )

    def parse(batches):
        import hashlib

        import pyarrow as pa

        def sha(text: str) -> str:
            return hashlib.sha256(text.encode()).hexdigest()

        for batch in batches:
            out = []
            for whole, mask in zip(batch.column("formatted").to_pylist(), batch.column("loss_mask").to_pylist(), strict=True):
                turns = read_turns(whole)
                learnt = "".join(plain(whole[m["start"] : m["end"]]) for m in mask)
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                out.append((len(turns), sha(said), len(learnt), sha(learnt), len(whole)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *arrays], schema.names)

    return texts.select("conv_id", "formatted", "loss_mask").mapInArrow(parse, schema)

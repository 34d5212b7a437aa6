"""Reply trees to formatted conversations, with DataFrame functions only.

Iterative self-joins double the distance that every message can look up its tree. That gives each
leaf the score of its branch, and then, from the chosen leaves downwards through the same tables,
all messages of their paths. Each path becomes one text with marked turns; the marks' characters
are escaped inside texts, so turns and loss spans can be read back exactly.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linesieve.llm.common import saved

# The marks around a turn, by role. Every mark begins and ends with [ ] < > or fixed white space.
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
OTHER_MARKS = ("[ROLE ", "] ", " [/ROLE]")
#: A turn as it stands in a formatted text: escaped texts hold neither [ nor <.
TURN = (r"<<SYS>>\n[^\[<]*\n<</SYS>>\n\n|<s>\[INST\] [^\[<]* \[/INST\]| [^\[<]* </s>|\[ROLE [^\[<]* \[/ROLE\]")


def escaped(text: Column) -> Column:
    """``text`` without [ and <, and without ] for roles' sake: each becomes a tilde and a digit, reversibly."""
    for char, code in (("~", "~0"), ("[", "~1"), ("<", "~2"), ("]", "~3")):
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for char, code in (("]", "~3"), ("<", "~2"), ("[", "~1"), ("~", "~0")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def _by_role(role: Column, value, other) -> Column:
    out = F
    for name, marks in MARKS.items():
        out = out.when(role == name, value(*marks))
    return out.otherwise(other)


def turn_text(role: Column, text: Column) -> Column:
    """One formatted turn; a null text or role is empty."""
    body, name = escaped(F.coalesce(text, F.lit(""))), F.coalesce(role, F.lit(""))
    other = F.concat(F.lit(OTHER_MARKS[0]), escaped(name), F.lit(OTHER_MARKS[1]), body, F.lit(OTHER_MARKS[2]))
    return _by_role(name, lambda before, after: F.concat(F.lit(before), body, F.lit(after)), other)


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text, unescaped."""

    def body(turn, before, after):
        return unescaped(F.substring(turn, F.lit(len(before) + 1), F.length(turn) - (len(before) + len(after))))

    def read(turn):
        out = F
        for name, (before, after) in MARKS.items():
            out = out.when(F.startswith(turn, F.lit(before)), F.struct(F.lit(name).alias("role"), body(turn, before, after).alias("text")))
        at = F.instr(turn, "]")
        role = unescaped(F.substring(turn, F.lit(len(OTHER_MARKS[0]) + 1), at - (len(OTHER_MARKS[0]) + 1)))
        rest = unescaped(F.substring(turn, at + 2, F.length(turn) - at - 1 - len(OTHER_MARKS[2])))
        return out.otherwise(F.struct(role.alias("role"), rest.alias("text")))

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), read)


def _jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables (node, up) of the message 1, 2, 4, ... steps up, and (node, total): the scores from each message to its root.

    A message leaves the joins once its root is reached, so they hold no more than the steps still
    open. Messages on or under a cycle of replies never reach a root; doubling stops when the
    distance exceeds all messages.
    """
    limit, distance = nodes.count(), 1
    level = saved(nodes.select("node", "up", F.coalesce("score", F.lit(0.0)).alias("total")))
    tables, done = [], level.filter("up IS NULL")
    while True:
        open_steps = level.filter("up IS NOT NULL")
        if distance > limit or open_steps.isEmpty():
            return tables, done.select("node", "total")
        tables.append(open_steps.select("node", "up"))
        far = open_steps.union(done).toDF("up", "far", "more")
        level = saved(open_steps.join(far, "up").select("node", F.col("far").alias("up"), (F.col("total") + F.col("more")).alias("total")))
        done = done.union(level.filter("up IS NULL"))
        distance *= 2


def paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """Root-to-leaf paths of reply trees: conv, branch, leaf, pos (0 at the leaf), node, role, text, score of the branch.

    ``messages``: conv, id, parent, role, text, score. A message whose parent is null or missing is
    a root. Of messages with one id the first in order of role and text is the one replied to.
    ``branch`` ranks a conversation's leaves by the sum of scores on their path (null score: 0),
    highest first, ties to the smaller leaf id; ``branches`` keeps so many of each conversation.
    Messages on or below a cycle have no root and form no path.
    """
    own = messages.select("conv", "id", "parent", "role", "text", F.col("score").cast("double").alias("score"))
    nodes = saved(own.withColumn("node", F.monotonically_increasing_id()))
    first = nodes.groupBy("conv", "id").agg(F.min_by("node", F.struct("role", "text", "node")).alias("up"))
    first = first.filter("id IS NOT NULL").select(F.col("conv").alias("c"), F.col("id").alias("i"), "up")
    linked = saved(nodes.select("node", "conv", "id", "parent", "score").join(
        first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("i")), "left").select("node", "conv", "id", "up", "score"))
    tables, rooted = _jumps(linked)
    leaves = linked.join(linked.select(F.col("up").alias("node")), "node", "left_anti").join(rooted, "node")
    by_score = Window.partitionBy("conv").orderBy(F.col("total").desc(), "id", "node")
    ranked = leaves.withColumn("branch", F.row_number().over(by_score))
    if branches is not None:
        ranked = ranked.filter(F.col("branch") <= branches)
    ranked = saved(ranked.select(F.col("node").alias("leaf"), "conv", "branch", "total"))
    steps = ranked.select("leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("pos"))
    for k, up in enumerate(tables):
        steps = saved(steps.union(steps.join(up, "node").select("leaf", F.col("up").alias("node"), F.col("pos") + (1 << k))))
    return (steps.join(ranked, "leaf").join(nodes.select("node", "role", "text"), "node")
            .select("conv", "branch", "leaf", "pos", "node", "role", "text", F.col("total").alias("score")))


def format_paths(found: DataFrame) -> DataFrame:
    """One row a path: conv, branch, score, n_turns, ``formatted`` and ``loss_spans`` (start, stop) in its code points.

    The spans hold the assistant texts as they stand there, escaped, without marks.
    """
    upto = Window.partitionBy("leaf").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)
    turns = found.withColumn("turn", turn_text(F.col("role"), F.col("text")))
    before, after = MARKS["assistant"]
    turns = turns.withColumn("at", F.coalesce(F.sum(F.length("turn")).over(upto), F.lit(0)))
    span = F.when(F.col("role") == "assistant", F.struct((F.col("at") + len(before)).alias("start"),
                                                          (F.col("at") + F.length("turn") - len(after)).alias("stop")))
    rows = turns.groupBy("leaf", "conv", "branch", "score").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("pos")).alias("order"), "turn", span.alias("span")))).alias("turns"))
    return rows.select(
        "conv", "branch", "score", F.size("turns").cast("long").alias("n_turns"),
        F.concat_ws("", F.transform("turns", lambda t: t["turn"])).alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["span"].isNotNull()), lambda t: t["span"]).alias("loss_spans"))


def conversations(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """``format_paths`` of the ``paths`` of reply trees. Repeated rows are messages of their own; extra columns take no part."""
    return format_paths(paths(messages, branches))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text of ``formatted`` under ``spans``, unescaped, nothing between."""
    return F.concat_ws("", F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))))


def chain(rows: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text): each replies to the one before it by turn, role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.withColumn("id", F.row_number().over(order)).select(
        F.col("conv_id").alias("conv"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text",
        F.lit(0.0).alias("score"))

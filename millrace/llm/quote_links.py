"""Chat formatting by quotation linking (operator 4), in DataFrame functions alone.

Lines are parsed into nested quote levels (leading ``>`` marks, blanks between them allowed). Runs of one level are
passages; they are normalised (case, white space) and hashed, and so are the messages' own sentences, lines, runs and whole texts.
A quoted passage is joined to the earliest earlier message of its conversation that said it, else to the earliest
message of another conversation that did; the shallowest linked passage names the message that is answered. Following the answers gives
each message its place in the reply order, and its text is kept without quotes.

Every join is on a hash (of conversation and passage), and messages are never gathered by conversation, so a
conversation with a third of all messages is spread like any other. A reply path takes two or three characters for each
message above, so the paths of one chain of n answers take some n * n characters in all.

Edge cases: a null text is empty; a message without linked quote starts a thread of its own; blank passages link nothing,
all others do, however short; a message can't answer itself or a later turn of its conversation; repeated rows (same
conversation and turn) say and quote together and share their links; null conversation ids or turns are kept and never
linked; turns may be negative or very large; an empty table gives an empty result; extra columns, whatever their names,
are left out, as only the four columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.storage import Workspace, scratch

#: The pattern of quote marks.
MARKS = r"^[ \t]*(?:>[ \t]*)+"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def lines(text: Column) -> Column:
    """Array of struct(level, body): quote marks counted and taken off."""
    marks = lambda x: F.regexp_extract(x, MARKS, 0)
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.struct(F.length(F.regexp_replace(marks(x), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("body")))


def runs(parsed: str) -> Column:
    """Array of struct(level, body): neighbouring lines of one level joined; blank lines end a run of own words."""
    kind = "array<struct<level:int,body:string>>"
    last = "element_at(a, -1)"
    joined = f"concat(slice(a, 1, size(a) - 1), array(named_struct('level', x.level, 'body', concat({last}.body, '\\n', x.body))))"
    step = f"CASE WHEN trim(x.body) = '' AND x.level = 0 THEN concat(a, array(named_struct('level', -1, 'body', ''))) WHEN size(a) > 0 AND {last}.level = x.level THEN {joined} ELSE concat(a, array(named_struct('level', x.level, 'body', x.body))) END"
    return F.expr(f"filter(aggregate({parsed}, cast(array() as {kind}), (a, x) -> {step}), x -> x.level >= 0)")


def own_text(text: Column) -> Column:
    """The message without quoted lines."""
    own = F.filter(lines(text), lambda x: x["level"] == 0)
    return F.btrim(F.regexp_replace(F.array_join(F.transform(own, lambda x: x["body"]), "\n"), r"\n{3,}", "\n\n"), F.lit(" \t\r\n"))


def _passages(messages: DataFrame) -> DataFrame:
    """``conv, turn, level, whole, size, hash``: level 0 rows are what a message said, others what it quoted. A message's
    whole own text, its runs (``whole`` = 1), its lines and the sentences of its runs are hashed."""
    parsed = messages.withColumn("parsed", lines(F.col("text"))).withColumn("runs", runs("parsed"))
    by_line = F.transform("parsed", lambda x: F.struct(x["level"].alias("level"), F.lit(0).alias("whole"), normalised(x["body"]).alias("body")))
    by_run = F.transform("runs", lambda x: F.struct(x["level"].alias("level"), F.lit(1).alias("whole"), normalised(x["body"]).alias("body")))
    sentences = lambda x: F.split(normalised(x["body"]), r"(?<=[.!?])\s")
    by_sentence = F.flatten(F.transform("runs", lambda x: F.transform(sentences(x), lambda s: F.struct(x["level"].alias("level"), F.lit(0).alias("whole"), s.alias("body")))))
    full = F.array(F.struct(F.lit(0).alias("level"), F.lit(1).alias("whole"), normalised(own_text(F.col("text"))).alias("body")))
    out = parsed.select("conv", "turn", F.explode(F.array_distinct(F.concat(full, by_run, by_line, by_sentence))).alias("p"))
    return out.where(F.length("p.body") > 0).select("conv", "turn", "p.level", "p.whole", F.length("p.body").alias("size"), F.unhex(F.md5(F.col("p.body").cast("binary"))).alias("hash"))


def link(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", workspace: Workspace | None = None) -> DataFrame:
    """``conv, turn, parent_conv, parent_turn``: the message that each quoting message answers."""
    ws = workspace or Workspace(conversations.sparkSession, "quotes")
    messages = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(text_col).alias("text")).where("conv is not null and turn is not null")
    passages = ws.save(_passages(messages), "passages")
    # only hashes that somebody quotes are looked up
    quoted = passages.where("level > 0").distinct()
    said = passages.where("level = 0").join(quoted.select("hash").distinct(), "hash", "left_semi")
    here = ws.save(said.groupBy("conv", "hash").agg(F.min("turn").alias("said_turn")), "here")
    # the two smallest conversations of a passage, as the quoting one may be the first
    sayer = F.min(F.struct("conv", F.col("said_turn").alias("turn")))
    first = ws.save(here.groupBy("hash").agg(sayer.alias("first")), "first")
    second = here.join(first, "hash").where(F.col("conv") != F.col("first.conv")).groupBy("hash").agg(sayer.alias("second"))
    anywhere = ws.save(first.join(second, "hash", "left"), "anywhere")
    found = quoted.join(here.where("said_turn is not null"), ["conv", "hash"], "left").join(anywhere, "hash", "left")
    near = F.coalesce(F.col("said_turn") < F.col("turn"), F.lit(False))
    elsewhere = F.when(F.col("first.conv") != F.col("conv"), F.col("first")).otherwise(F.col("second"))
    target = F.when(near, F.struct(F.lit(0).alias("far"), F.col("conv").alias("pc"), F.col("said_turn").alias("pt"))).when(elsewhere.isNotNull(), F.struct(F.lit(1).alias("far"), elsewhere["conv"].alias("pc"), elsewhere["turn"].alias("pt")))
    linked = found.withColumn("target", target).where("target is not null")
    # within the conversation first, then the shallowest level, whole passages, the longest one, the latest message
    best = F.min_by("target", F.struct(F.col("target.far"), "level", -F.col("whole"), -F.col("size"), F.negative(F.col("target.pt").cast("decimal(20,0)")), F.col("target.pc")))
    links = linked.groupBy("conv", "turn").agg(best.alias("t")).select("conv", "turn", F.col("t.pc").alias("parent_conv"), F.col("t.pt").alias("parent_turn"))
    return ws.save(links, "links")


def sortable(turn: Column) -> Column:
    """A turn as text that sorts like the number and says where it ends: a letter for the length, then the digits, all in
    reverse for negative ones."""
    digits = F.regexp_replace(turn.cast("string"), "-", "")
    n = F.length(digits)
    mark = lambda first, step: F.element_at(F.array(*[F.lit(chr(first + step * k)) for k in range(19)]), n)
    below = F.concat(mark(ord("Z"), -1), F.translate(digits, "0123456789", "9876543210"))
    above = F.concat(mark(ord("a"), 1), digits)
    return F.when(turn < 0, below).otherwise(above)


def reply_order(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", workspace: Workspace | None = None) -> DataFrame:
    """Every message without its quotes, with the message it answers, its depth and ``reply_key``: ordered by
    conversation and key, each message follows the one it answers, and threads follow in order of their first turn.

    Answers to other conversations are reported and don't move a message. The path to a thread's first message is
    found by doubling: each round joins every open path with the path of the message where it ends.
    """
    ws = scratch(conversations.sparkSession, "quotes", workspace)
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    links = link(rows, "conv", "turn", "text", ws)
    step = lambda c: sortable(F.col(c).cast("bigint"))
    paths = ws.save(links.where("parent_conv = conv").select("conv", "turn", F.col("parent_turn").alias("end"), step("turn").alias("path"), F.lit(1).alias("depth")), "paths")
    while True:
        upper = paths.select("conv", F.col("turn").alias("end"), F.col("end").alias("e2"), F.col("path").alias("p2"), F.col("depth").alias("d2"))
        moved = F.col("e2").isNotNull()
        longer = paths.join(upper, ["conv", "end"], "left").select(
            "conv", "turn", F.coalesce("e2", "end").alias("end"), F.when(moved, F.concat("p2", "path")).otherwise(F.col("path")).alias("path"),
            F.when(moved, F.col("depth") + F.col("d2")).otherwise(F.col("depth")).alias("depth"), moved.alias("moved"),
        )
        longer = ws.save(longer, "longer")
        ws.drop(paths)
        paths = longer.drop("moved")
        paths._millrace_path = longer._millrace_path
        if not longer.where("moved").limit(1).count():
            break
    ws.keep(links, longer)
    keys = paths.select("conv", "turn", "depth", F.col("end").alias("root_turn"), F.concat(step("end"), "path").alias("key"))
    joined = rows.join(links, ["conv", "turn"], "left").join(keys, ["conv", "turn"], "left")
    return joined.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), "parent_conv", "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("key", step("turn")).alias("reply_key"),
        F.size(F.filter(lines(F.col("text")), lambda x: x["level"] > 0)).alias("quoted_lines"), own_text(F.col("text")).alias("text"),
    )


def op4(spark, sf_dir: str) -> DataFrame:
    return reply_order(spark.read.parquet(f"{sf_dir}/conversations.parquet"))

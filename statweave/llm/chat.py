"""Chat formatting by prefix-target expansion: every assistant turn is an example with all turns before it as context and only its reply trainable."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statweave.llm.shared import table

#: Control strings of the template and their escapes within texts and roles; the backslash comes first.
ESCAPES = (("\\", "\\\\"), ("</s>", "\\e"), ("<s>", "\\b"), ("[INST]", "\\i"), ("[/INST]", "\\j"), ("<<SYS>>", "\\y"), ("<</SYS>>", "\\z"), ("[TURN]", "\\t"), ("[/TURN]", "\\u"))
OPENING = "<s>"
USER, SYSTEM, OTHER, ASSISTANT = ("[INST] ", " [/INST]"), ("<<SYS>> ", " <</SYS>>"), ("[TURN] ", " [/TURN]"), ("", "</s>")
_TURN_ENDS = "(?<=</s>)|(?<= \\[/INST\\])|(?<= <</SYS>>)|(?<= \\[/TURN\\])"


def escaped(text: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), ESCAPES, text)


def unescaped(text: Column) -> Column:
    """The inverse: pairs of backslashes part the text, and between them an escape's letter follows a single one."""
    whole = lambda part: reduce(lambda c, x: F.replace(c, F.lit(x[1]), F.lit(x[0])), ESCAPES[1:], part)
    return F.when(F.instr(text, "\\") == 0, text).otherwise(F.array_join(F.transform(F.split(text, "\\\\\\\\", -1), whole), "\\"))


def _rendered(role: Column, text: Column) -> Column:
    """(text before the loss, text under the loss or null, text after it) of a turn, as segments of text and trainable."""
    segment = lambda c, trainable: F.struct(c.alias("text"), F.lit(trainable).alias("trainable"))
    around = lambda marks, inner: F.array(segment(F.concat(F.lit(marks[0]), inner, F.lit(marks[1])), False))
    other = F.concat(F.replace(escaped(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"), escaped(text))
    return (F.when(role == "assistant", F.array(segment(escaped(text), True), segment(F.lit(ASSISTANT[1]), False)))
            .when(role == "user", around(USER, escaped(text))).when(role == "system", around(SYSTEM, escaped(text))).otherwise(around(OTHER, other)))


def format_conversations(turns: DataFrame, block: int = 64) -> DataFrame:
    """conv_id and segments (text, trainable): a conversation's formatted text is the segments' texts joined, and the loss mask covers the trainable ones.

    Turns (conv_id, turn, role, text) are ordered by turn, then by their rendered text; null turns come first, null text and role are empty, a null conv_id is a
    conversation like others, repeated rows are repeated turns, other columns are ignored, and no rows give no rows. Control strings within texts are escaped.
    Turns meet in blocks of `block` turn numbers first, so a long conversation comes together in a few rows."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    parts = turns.select("conv_id", F.floor(F.col("turn") / block).alias("part"), F.struct("turn", _rendered(role, text).alias("segments")).alias("t"))
    joined = parts.groupBy("conv_id", "part").agg(F.flatten(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["segments"])).alias("segments"))
    # nulls sort last in array_sort, so a flag leads
    order = F.struct(F.col("part").isNotNull().alias("has"), "part", "segments")
    start = F.array(F.struct(F.lit(OPENING).alias("text"), F.lit(False).alias("trainable")))
    return joined.groupBy("conv_id").agg(F.concat(start, F.flatten(F.transform(F.array_sort(F.collect_list(order)), lambda t: t["segments"]))).alias("segments"))


def expand(formatted: DataFrame, open_end: bool = False) -> DataFrame:
    """One example per trainable segment: conv_id, example (its place), target (the reply, escaped) and context (all formatted text before it). With open_end every conversation has one
    more, the whole text as context of a reply that is not given (target null).

    Contexts repeat what came before, so their length grows with the square of a conversation's; a row holds one of them. Where a caller doesn't select them they are not made."""
    at = F.filter(F.transform("segments", lambda s, i: F.when(s["trainable"], i)), lambda i: i.isNotNull())
    place = formatted.select("conv_id", "segments", F.explode(F.concat(at, F.array(F.size("segments"))) if open_end else at).alias("example"))
    context = F.array_join(F.transform(F.slice("segments", 1, F.col("example")), lambda s: s["text"]), "")
    return place.select("conv_id", "example", F.get("segments", "example")["text"].alias("target"), context.alias("context"))


def steps(formatted: DataFrame) -> DataFrame:
    """The chain of examples: conv_id, example (its place), added (the formatted text that its context has beyond the example before it and that one's target), target (the reply, escaped),
    and digests of the context before `added` (before) and of context and target (through). The last step, without a target, is the open example.

    Every example is made and read by itself: its context is whole, and what it adds begins with the end mark of the reply before, which no escaped text holds. Only `added`, target and
    digests, as long as the conversation in all, go on."""
    end = F.lit(ASSISTANT[1])
    seen = F.when(F.contains("context", end), F.substr("context", F.lit(1), F.length("context") - F.length(F.substring_index("context", ASSISTANT[1], -1)) - len(ASSISTANT[1]))).otherwise("")
    examples = expand(formatted, open_end=True).withColumn("seen", seen)
    return examples.select("conv_id", "example", F.substr("context", F.length("seen") + 1).alias("added"), "target", F.sha2("seen", 256).alias("before"),
                           F.sha2(F.concat("context", "target"), 256).alias("through"))


def read_steps(chain: DataFrame) -> DataFrame:
    """conv_id, text (the formatted text that the chain of examples holds) and loss (its unescaped targets, in order). A context that is not all of the example before it raises."""
    whole = chain.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("example", "added", "target", "before", "through"))).alias("steps"))
    follows = F.forall(F.zip_with(F.slice("steps", 2, F.size("steps")), "steps", lambda s, last: s.isNull() | s["before"].eqNullSafe(last["through"])), lambda x: x)
    text = F.array_join(F.transform("steps", lambda s: F.concat(s["added"], F.coalesce(s["target"], F.lit("")))), "")
    loss = F.array_join(F.transform("steps", lambda s: unescaped(F.coalesce(s["target"], F.lit("")))), "")
    wrong = F.raise_error(F.concat(F.lit("an example's context is not what precedes it in conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))).cast("string")
    return whole.select("conv_id", F.when(follows, text).otherwise(wrong).alias("text"), loss.alias("loss"))


def read_turns(text: Column) -> Column:
    """The turns (role, text) that a formatted text holds."""
    pieces = F.filter(F.split(F.substr(text, F.lit(len(OPENING) + 1)), _TURN_ENDS, -1), lambda p: p != "")
    inner = lambda p, marks: F.substr(p, F.lit(len(marks[0]) + 1), F.length(p) - len(marks[0]) - len(marks[1]))
    turn = lambda role, c: F.struct(role.alias("role"), unescaped(c).alias("text"))

    def other(p: Column) -> Column:
        body = inner(p, OTHER)
        cut_at = F.instr(body, "\n")
        return turn(unescaped(F.replace(F.substr(body, F.lit(1), cut_at - 1), F.lit("\\n"), F.lit("\n"))), F.substr(body, cut_at + 1))

    return F.transform(pieces, lambda p: F.when(F.startswith(p, F.lit(USER[0])), turn(F.lit("user"), inner(p, USER)))
                       .when(F.startswith(p, F.lit(SYSTEM[0])), turn(F.lit("system"), inner(p, SYSTEM)))
                       .when(F.startswith(p, F.lit(OTHER[0])), other(p)).otherwise(turn(F.lit("assistant"), inner(p, ASSISTANT))))


def op8_prefix_target_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)
    back = read_steps(steps(format_conversations(turns)))          # everything below is read from the examples
    read = back.select("conv_id", "loss", F.length("text").alias("formatted_chars"), read_turns(F.col("text")).alias("turns"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '</s>', '\e'), '<s>', '\b'), '[INST]', '\i'), '[/INST]', '\j'),
         '<<SYS>>', '\y'), '<</SYS>>', '\z'), '[TURN]', '\t'), '[/TURN]', '\u') AS escaped FROM c),
f AS (
  SELECT *, length(escaped) + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 17 WHEN 'assistant' THEN 4 ELSE 16 + length(role) END AS chars FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       COALESCE(CAST(sum(length(text)) FILTER (WHERE role = 'assistant') AS BIGINT), 0) AS loss_chars,
       sha256(COALESCE(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(3 + sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""

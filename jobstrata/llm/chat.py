"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own, with all turns before
it as context and only that reply trainable.

A turn is written `<s>role\\ntext</s>`. Inside roles and texts `~`, `<` and `[` (and, in roles, the line break) are written
`~0` to `~3`, so no control string can appear there, and reading back restores them. Turns after the last reply form a
closing example without a trainable part, so the output holds the whole conversation. An example is one row and holds
all its context, so a task needs the memory of the longest conversation, as any reader of its last example does. The
examples of a long conversation, which grow with the square of its turns, are written by many tasks, RUN at a time."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>"
RUN = 64  # examples of a conversation that one row deals out
# The escape of each character, in the order in which escaping applies them.
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"), ("\n", "~3"))


def escape(text: Column, line_breaks: bool = False) -> Column:
    for raw, coded in ESCAPES if line_breaks else ESCAPES[:-1]:
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for raw, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(raw))
    return text


def expand(turns: DataFrame, run: int = RUN) -> DataFrame:
    """conv_id, example_no, text, loss_start, loss_end (code points; both null where nothing is trainable), closing.

    Turns are ordered by (turn, role, text), nulls first; a null role or text counts as empty; rows that repeat are
    turns of their own; a null conv_id is a conversation like any other. Other columns of `turns` are not read."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conv = turns.select("conv_id", row.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, since the rows are short before they are expanded
    n = F.size("turns")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (F.get("turns", i - 1)["role"] == "assistant") | (i == n))
    conv = conv.select("conv_id", "turns", n.alias("n"), ends.alias("ends"))
    short = conv.where(F.size("ends") <= run).withColumn("first", F.lit(0))
    long_ = (conv.where(F.size("ends") > run).withColumn("first", F.explode(F.sequence(F.lit(0), F.size("ends") - 1, F.lit(run))))
             .withColumn("ends", F.slice("ends", F.col("first") + 1, run)).withColumn("turns", F.slice("turns", F.lit(1), F.element_at("ends", -1))).repartition(tasks, "conv_id", "first"))
    chunk = lambda t: F.concat(F.lit(OPEN), escape(t["role"], True), F.lit("\n"), escape(t["text"]), F.lit(CLOSE))
    spread = (short.unionByName(long_).select("conv_id", "turns", F.transform("turns", chunk).alias("chunks"), "n", "first", "ends")
              .select("conv_id", "turns", "chunks", "n", "first", F.posexplode("ends").alias("place", "last")).withColumn("example_no", F.col("first") + F.col("place")))
    reply, trainable = F.get("turns", F.col("last") - 1), F.get("turns", F.col("last") - 1)["role"] == "assistant"
    text = spread.select("conv_id", "example_no", F.array_join(F.slice("chunks", 1, F.col("last")), "").alias("text"), (F.col("last") == F.col("n")).alias("closing"),
                         F.when(trainable, F.length(escape(reply["text"]))).alias("_reply"))
    end = F.length("text") - len(CLOSE)
    return text.select("conv_id", "example_no", "text", F.when(F.col("_reply").isNotNull(), end - F.col("_reply")).alias("loss_start"), F.when(F.col("_reply").isNotNull(), end).alias("loss_end"), "closing")


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: n_turns, turns (role, line break, text, line break for each), loss
    (trainable texts in order) and formatted_chars (code points of all examples)."""
    loss = F.when(F.col("loss_start").isNotNull(), unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))))
    per_conv = (examples.select("conv_id", F.length("text").cast("long").alias("chars"), F.when(F.col("closing"), F.col("text")).alias("whole"), F.struct("example_no", loss.alias("loss")).alias("part"))
                .groupBy("conv_id").agg(F.max("whole").alias("whole"), F.array_sort(F.collect_list("part")).alias("parts"), F.sum("chars").alias("formatted_chars")))
    pieces = F.split(F.col("whole"), CLOSE, -1)
    cut = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p)))
    shown = F.transform(cut, lambda p: F.concat(unescape(F.substring_index(p, "\n", 1)), F.lit("\n"), unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p))), F.lit("\n")))
    return per_conv.select("conv_id", (F.size(pieces) - 1).cast("long").alias("n_turns"), F.array_join(shown, "").alias("turns"),
                           F.array_join(F.transform("parts", lambda p: p["loss"]), "").alias("loss"), "formatted_chars")


def digests(turns: DataFrame) -> DataFrame:
    """What the contract of the query asks for, read back from the formatted examples."""
    back = read_back(expand(turns))
    return back.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


DIGEST_SQL = """
WITH input AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
           length(role) + length(text) + length(regexp_replace(role || text, '[^~<\\[]', '', 'g')) + length(regexp_replace(role, '[^\\n]', '', 'g')) + 8 AS chars
    FROM input),
counted AS (
    SELECT *, sum(CASE WHEN role = 'assistant' OR i = n THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shown
    FROM placed)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars * shown) AS BIGINT) AS formatted_chars
FROM counted GROUP BY conv_id
"""

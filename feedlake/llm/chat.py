"""Chat formatting: every participant's perspective on a dialogue of several parties.

Method. For each participant of a conversation its turns are rendered once with that speaker as the assistant and all others as
users with their names; system turns stay what they are. The assistant's spans, i.e. what a model would learn from, are given
as offsets into the rendered text. Only DataFrame functions are used.

Scale. Turns are grouped by conversation and ``PART_TURNS`` turn numbers: a dialogue of any length comes as parts that follow
each other, so the conversation that holds a third of all turns is many groups. Where turn numbers are null or repeat, a part is cut into
pieces of ``PART_TURNS`` rows, so no array holds more. Its rows are numbered by a sort that spills: turns without numbers of one conversation take one task's time, but not its
memory. The participants of a conversation are found by a partial aggregation and joined to its pieces.

Rows. A null text is an empty turn, a null or empty speaker is called ``unknown``, a null turn number is 0. Turns with one number come in the order of speaker and
text, and repeated rows are rendered as often as they come. Null conversation ids are one conversation. A conversation
of system turns alone has no participant, hence no row. ``<|`` in a text or name is written ``< |``, and a line feed in a name a blank, so neither
can end a turn or open another's. Turn numbers may be any 64-bit numbers. Every participant sees every turn, so the result grows as participants times turns of
a conversation, by the method. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PART_TURNS = 256
SYSTEM = "system"
UNKNOWN = "unknown"
START, END = "<|im_start|>", "<|im_end|>"


def perspectives(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, perspective, part, piece, n_turns, text, masks`` for every participant of every conversation.

    ``masks`` lists the assistant's spans as ``begin:end`` in characters of the piece's text, separated by commas: text and end mark of its turns.
    """
    number = F.coalesce(F.col(turn).cast("bigint"), F.lit(0))
    name = F.coalesce(F.nullif(F.col(speaker).cast("string"), F.lit("")), F.lit(UNKNOWN))
    said = F.replace(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))
    rows = turns.select(F.col(conversation).alias("conv_id"), number.alias("turn"), name.alias("speaker"), said.alias("body"))
    people = rows.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    # whole numbers only: a quotient of doubles would round large ones
    part = F.expr(f"(turn - pmod(turn, {PART_TURNS})) div {PART_TURNS}")
    # the window has dealt the rows by conversation and part, so the grouping needs no further shuffle
    in_part = Window.partitionBy("conv_id", "part").orderBy("turn", "speaker", "body")
    piece = F.floor((F.row_number().over(in_part) - 1) / PART_TURNS).cast("int")
    parts = rows.withColumn("part", part).withColumn("piece", piece).groupBy("conv_id", "part", "piece").agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "body"))).alias("turns"))

    def rendered(t: F.Column) -> F.Column:
        role = F.when(t["speaker"] == F.col("perspective"), F.lit("assistant")).when(t["speaker"] == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), F.replace(F.replace(t["speaker"], F.lit("<|"), F.lit("< |")), F.lit("\n"), F.lit(" "))))
        head = F.concat(F.lit(START), role, F.lit("\n"))
        whole = F.concat(head, t["body"], F.lit(END + "\n"))
        return F.struct(whole.alias("whole"), F.length(head).cast("bigint").alias("head"), (t["speaker"] == F.col("perspective")).alias("own"))

    def step(so_far: F.Column, t: F.Column) -> F.Column:
        stop = so_far["at"] + F.length(t["whole"])
        span = F.concat_ws(":", (so_far["at"] + t["head"]).cast("string"), (stop - 1).cast("string"))
        return F.struct(stop.alias("at"), F.when(t["own"], F.array_append(so_far["spans"], span)).otherwise(so_far["spans"]).alias("spans"))

    joined = parts.join(people, F.col("conv_id").eqNullSafe(F.col("of"))).withColumn("segments", F.transform("turns", rendered))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("spans"))
    return joined.select(
        "conv_id",
        "perspective",
        "part",
        "piece",
        F.size("segments").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("segments", lambda s: s["whole"]), "").alias("text"),
        F.array_join(F.aggregate("segments", start, step)["spans"], ",").alias("masks"),
    )


#: The same over the table ``conversations``.
SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(turn, 0) AS turn, coalesce(nullif(role, ''), '{UNKNOWN}') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS body
  FROM conversations
), parts AS (
  SELECT *, CAST((turn - ((turn % {PART_TURNS}) + {PART_TURNS}) % {PART_TURNS}) // {PART_TURNS} AS BIGINT) AS part FROM turns
), pieces AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY conv_id, part ORDER BY turn, speaker, body) - 1) // {PART_TURNS} AS INT) AS piece FROM parts
), people AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> '{SYSTEM}'
), headed AS (
  SELECT t.conv_id, p.perspective, t.part, t.piece, t.turn, t.speaker, t.body,
    concat('{START}', CASE WHEN t.speaker = p.perspective THEN 'assistant' WHEN t.speaker = '{SYSTEM}' THEN '{SYSTEM}' ELSE concat('user name=', replace(replace(t.speaker, '<|', '< |'), chr(10), ' ')) END, chr(10)) AS head
  FROM pieces t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), placed AS (
  SELECT *, concat(head, body, '{END}', chr(10)) AS whole,
    sum(length(concat(head, body, '{END}', chr(10)))) OVER (PARTITION BY conv_id, perspective, part, piece ORDER BY turn, speaker, body ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop
  FROM headed
)
SELECT conv_id, perspective, part, piece, count(*) AS n_turns, string_agg(whole, '' ORDER BY turn, speaker, body, stop) AS text,
  coalesce(string_agg(CASE WHEN speaker = perspective THEN concat(CAST(stop - length(whole) + length(head) AS BIGINT), ':', CAST(stop - 1 AS BIGINT)) END, ',' ORDER BY turn, speaker, body, stop), '') AS masks
FROM placed GROUP BY conv_id, perspective, part, piece
"""

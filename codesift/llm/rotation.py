"""Chat formatting with rotated perspectives: each speaker of a dialogue in turn is the assistant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# production parameters
SEGMENT_TURNS = 1024  # a rendering is split into rows of so many turns; ``rotated``: turn numbers
SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _clean(text: Column) -> Column:
    """Delimiters inside a text must not open or close a message."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _name(role: Column) -> Column:
    return F.regexp_replace(_clean(F.coalesce(role, F.lit("unnamed"))), "[\\r\\n]", " ")


def _said() -> Column:
    return F.struct("turn", "role", "text")


def _placed() -> Column:
    return F.col("conv_id").isNotNull() & F.col("turn").isNotNull()


def _rows(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "turn", _name(F.col("role")).alias("role"), _clean(F.col("text")).alias("text"))


def _alone(rows: DataFrame) -> DataFrame:
    return rows.filter(~_placed()).select("conv_id", F.lit(None).cast("long").alias("segment"), F.array(_said()).alias("turns"))


def _other(role: Column) -> Column:
    """How a turn that is not the assistant's is announced."""
    return F.when(role == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user name="), role))


def _render(each: DataFrame) -> DataFrame:
    """each(conv_id, segment, turns, perspective, offset): spans count from ``offset`` on."""

    def head(t: Column) -> Column:
        return F.concat(F.lit(OPEN), F.when(t["role"] == F.col("perspective"), "assistant").otherwise(_other(t["role"])), F.lit("\n"))

    parts = each.withColumn("parts", F.transform("turns", lambda t: F.struct(
        head(t).alias("head"), F.concat(t["text"], F.lit(CLOSE)).alias("body"), (t["role"] == F.col("perspective")).alias("learn"))))
    rendered = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "")
    # running offset; a span is added at each of the speaker's turns
    zero = F.struct(F.col("offset").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(p["learn"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return parts.select("conv_id", "segment", "perspective", F.size("turns").cast("long").alias("n_turns"), rendered.alias("rendered"),
                        F.aggregate("parts", zero, step)["spans"].alias("spans"))


def rotated(turns: DataFrame, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, segment, perspective, n_turns, rendered, spans.

    For every speaker of a stretch the whole stretch is rendered: this speaker's turns as those of the assistant,
    the others' as those of users with a name, the system's as they are.  spans are the code points [start, end)
    to learn from: the assistant's words with the end mark behind them.

    Turns of one number stand in the order of speaker and text; a repeated row is one turn.  Null text is empty, a
    null role is a speaker called "unnamed".  Without conv_id or turn a row has no place in a dialogue and is one
    of its own, segment null.  A stretch without a speaker (only system turns) has no perspective and no row.
    """
    rows = _rows(turns)
    dialogues = rows.filter(_placed()).distinct().groupBy(
        "conv_id", F.floor(F.col("turn") / segment_turns).cast("long").alias("segment")).agg(F.sort_array(F.collect_list(_said())).alias("turns"))
    speakers = F.array_distinct(F.filter(F.transform("turns", lambda t: t["role"]), lambda r: r != SYSTEM))
    return _render(dialogues.unionByName(_alone(rows)).withColumn("perspective", F.explode(F.array_sort(speakers))).withColumn("offset", F.lit(0).cast("long")))


def rotated_dialogues(turns: DataFrame, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """As ``rotated``, but every speaker of a dialogue has all of it, of whatever length.

    A rendering is split into rows of segment_turns turns, counted by rank, so that no row holds more however the
    turns are numbered.  The rows of a (conv_id, perspective) put together by segment are the rendering; spans count from
    its beginning.  A dialogue without a speaker has no row.
    """
    rows = _rows(turns)
    # rank by blocks of turn numbers, so that a long dialogue is not sorted by one task
    block = F.floor(F.col("turn") / segment_turns).alias("block")
    said = rows.filter(_placed()).distinct().select("*", block)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = said.groupBy("conv_id", "block").count().select(
        "conv_id", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text"))
    ranked = said.withColumn("place", place).join(sizes, ["conv_id", "block"]).withColumn(
        "segment", F.floor((F.col("before") + F.col("place") - 1) / segment_turns).cast("long"))
    pieces = ranked.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(_said())).alias("turns"))
    # characters of a segment in each perspective, from narrow rows
    role, mark = F.col("role"), lambda who: F.length(F.concat(F.lit(OPEN), who, F.lit("\n"), "text", F.lit(CLOSE + "\n"))).cast("long")
    plain, own = mark(_other(role)), mark(F.lit("assistant"))
    by_role = ranked.groupBy("conv_id", "segment", "role").agg(F.sum(plain).alias("plain"), F.sum(own - plain).alias("more"))
    speakers = by_role.filter(role != SYSTEM).select("conv_id", F.col("role").alias("perspective")).distinct()
    mine = by_role.select("conv_id", "segment", F.col("role").alias("perspective"), "more")
    grid = by_role.groupBy("conv_id", "segment").agg(F.sum("plain").alias("plain")).join(speakers, "conv_id").join(
        mine, ["conv_id", "segment", "perspective"], "left")
    before = Window.partitionBy("conv_id", "perspective").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    chars = F.col("plain") + F.coalesce("more", F.lit(0))
    grid = grid.select("conv_id", "segment", "perspective", F.coalesce(F.sum(chars).over(before), F.lit(0)).cast("long").alias("offset"))
    alone = _alone(rows).withColumn("perspective", F.col("turns")[0]["role"]).filter(F.col("perspective") != SYSTEM).withColumn(
        "offset", F.lit(0).cast("long"))
    return _render(pieces.join(grid, ["conv_id", "segment"]).unionByName(alone))


def digests(rotations: DataFrame) -> DataFrame:
    """Narrow columns that can be compared."""
    return rotations.select(
        "conv_id", "segment", "perspective", "n_turns", F.length("rendered").cast("long").alias("n_chars"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_learned"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
        F.sha2("rendered", 256).alias("rendered_sha256"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, replace(coalesce(text, ''), '<|', '< |') AS text,
         regexp_replace(replace(coalesce(role, 'unnamed'), '<|', '< |'), '[\r\n]', ' ', 'g') AS role
  FROM conversations),
s AS (SELECT DISTINCT * FROM t WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
ranked AS (SELECT *, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) // %d AS BIGINT) AS segment FROM s),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM s WHERE role <> 'system'),
m AS (
  SELECT r.*, p.perspective, r.role = p.perspective AS learn,
    '<|im_start|>' || CASE WHEN r.role = p.perspective THEN 'assistant' WHEN r.role = 'system' THEN 'system'
                           ELSE 'user name=' || r.role END || chr(10) AS head, r.text || '<|im_end|>' AS body
  FROM ranked r JOIN p USING (conv_id)),
o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY turn, role, text
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start
  FROM m),
alone AS (SELECT *, '<|im_start|>assistant' || chr(10) AS head, text || '<|im_end|>' AS body FROM t
          WHERE (conv_id IS NULL OR turn IS NULL) AND role <> 'system')
SELECT conv_id, segment, perspective, count(*) AS n_turns, CAST(sum(length(head) + length(body) + 1) AS BIGINT) AS n_chars,
  CAST(sum(CASE WHEN learn THEN length(body) ELSE 0 END) AS BIGINT) AS n_learned,
  coalesce(string_agg(CASE WHEN learn THEN CAST(CAST(start AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(start + length(body) AS BIGINT) AS VARCHAR) END, ','
                      ORDER BY turn, role, text), '') AS spans,
  sha256(string_agg(head || body || chr(10), '' ORDER BY turn, role, text)) AS rendered_sha256
FROM o GROUP BY conv_id, segment, perspective
UNION ALL
SELECT conv_id, NULL, role, 1, length(head) + length(body) + 1, length(body),
  CAST(length(head) AS VARCHAR) || '-' || CAST(length(head) + length(body) AS VARCHAR), sha256(head || body || chr(10))
FROM alone
""" % SEGMENT_TURNS

"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered once with that
speaker as the assistant and everyone else as a named user; the mask covers what
the assistant says (content and end mark), so a loss is taken on that speaker
alone. Roles in ``context_roles`` (system prompts) are context for all: rendered
under their own name, never rotated, never in the mask.

A rendering comes in parts of ``part_turns`` messages, so a conversation of any
length never meets in one task or one row: parts joined in order are the whole
rendering, and mask offsets count from its beginning (``start`` is where the part
begins). Usual dialogues have one part. Messages are counted by their rank in the
conversation: the rows are dealt into ranges in order, ranks are a range's offset
plus the place in it.

Text that looks like one of the marks can't forge a turn: a backslash goes in
after the ``<`` of every ``<|`` (and one more where there are some already, so
that taking one away restores the text).

Edge cases: null or empty text renders as an empty message; a null role is the
speaker "unknown"; null conversation ids form one conversation; null turns come
first, turns of any sign in order, gaps between turn numbers don't matter; ties
of turn are ordered by role and text; repeated rows are repeated messages; a
conversation with context only gives no row; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlab.llm._common import staged, table

RANGE_ROWS = 200_000
END = "<|end|>\n"


def _name(role: Column) -> Column:
    r"""A role as a name inside a mark: backslashes before \, |, < and >, line breaks as \n and \r, so it can't end the mark."""
    shown = F.regexp_replace(role, r"([\\|<>])", r"\\$1")
    return F.replace(F.replace(shown, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def _head(role: Column, own: Column, context_roles: tuple[str, ...]) -> Column:
    user = F.when(role.isin(*context_roles), F.concat(F.lit("<|"), role, F.lit("|>\n"))).otherwise(F.concat(F.lit("<|user name="), _name(role), F.lit("|>\n")))
    return F.when(own, F.lit("<|assistant|>\n")).otherwise(user)


def _ranked(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, k): k counts the messages of a conversation from 0."""
    order = ["turn", "role", "text"]
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"<(\\*)\|", r"<\\$1|")
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), text.alias("text"))
    ranges = max(rows.sparkSession.sparkContext.defaultParallelism, -(-turns.count() // RANGE_ROWS))
    rows = staged(rows.repartitionByRange(ranges, "conv_id", *order).withColumn("range", F.spark_partition_id()), "turns")
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    held = rows.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    first = held.select(F.col("conv_id").alias("of"), F.col("range").alias("in"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    here = Window.partitionBy("conv_id", "range").orderBy(*order)
    rows = rows.withColumn("here", F.row_number().over(here) - 1)
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("range") == F.col("in")))
    return rows.select("conv_id", *order, (F.col("first") + F.col("here")).alias("k"))


def rotated(turns: DataFrame, context_roles: tuple[str, ...] = ("system",), part_turns: int = 512) -> DataFrame:
    """conv_id, speaker, part, start, text, mask array<struct<start, stop>> (code points of the whole rendering, stop exclusive), n_turns, own_turns."""
    rows = _ranked(turns).withColumn("part", F.floor(F.col("k") / part_turns))
    parts = staged(rows.groupBy("conv_id", "part").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("said")), "parts")

    # Sizes of the parts, without the texts: as rendered for nobody, and what the speaker's own messages change.
    each = parts.select("conv_id", "part", F.explode("said").alias("m")).select("conv_id", "part", F.col("m.role").alias("role"), F.length("m.text").alias("chars"))
    sizes = each.groupBy("conv_id", "part", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    sizes = staged(sizes.withColumn("head", F.length(_head(F.col("role"), F.lit(False), context_roles))), "sizes")
    whole = sizes.groupBy(F.col("conv_id").alias("of"), F.col("part").alias("at")).agg(F.sum(F.col("chars") + F.col("n") * (F.col("head") + len(END))).alias("size"))
    speakers = sizes.where(~F.col("role").isin(*context_roles)).select("conv_id", F.col("role").alias("speaker")).distinct()
    grid = speakers.join(whole, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", "speaker", F.col("at").alias("part"), "size")
    own = sizes.select(F.col("conv_id").alias("of"), F.col("role").alias("who"), F.col("part").alias("at"), (F.col("n") * (len("<|assistant|>\n") - F.col("head"))).alias("change"))
    grid = grid.join(own, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("speaker") == F.col("who")) & (F.col("part") == F.col("at")), "left")
    before = Window.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("size") + F.coalesce("change", F.lit(0))).over(before), F.lit(0))
    grid = grid.select(F.col("conv_id").alias("of"), "speaker", F.col("part").alias("at"), start.alias("start"))
    pairs = parts.join(grid, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")))

    def message(m):
        own = m["role"] == F.col("speaker")
        head = _head(m["role"], own, context_roles)
        return F.struct(own.alias("own"), F.length(head).cast("bigint").alias("skip"), F.concat(head, m["text"], F.lit(END)).alias("s"))

    shown = pairs.withColumn("shown", F.transform("said", message))
    begin = F.struct(F.col("start").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("mask"))

    def add(a, m):
        stop = a["at"] + F.length(m["s"])
        span = F.struct((a["at"] + m["skip"]).alias("start"), (stop - 1).alias("stop"))  # the line break after the end mark is not learnt
        return F.struct(stop.alias("at"), F.when(m["own"], F.concat(a["mask"], F.array(span))).otherwise(a["mask"]).alias("mask"))

    return shown.select(
        "conv_id",
        "speaker",
        "part",
        "start",
        F.array_join(F.transform("shown", lambda m: m["s"]), "").alias("text"),
        F.aggregate("shown", begin, add)["mask"].alias("mask"),
        F.size("shown").cast("bigint").alias("n_turns"),
        F.size(F.filter("shown", lambda m: m["own"])).cast("bigint").alias("own_turns"),
    )


def op9_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rotated(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"], m["stop"])), ",")
    chars = F.aggregate("mask", F.lit(0).cast("bigint"), lambda s, m: s + m["stop"] - m["start"])
    return out.select("conv_id", "speaker", "part", "start", "text", spans.alias("mask_spans"), chars.alias("mask_chars"), "n_turns", "own_turns")


# Renders each conversation whole and cuts the parts out of it.
SQL = r"""
WITH n AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS text FROM conversations
),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM n),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
m AS (
  SELECT t.conv_id, speaker, k, role, text, role = speaker AS own,
         CASE WHEN role = speaker THEN '<|assistant|>' || chr(10)
              WHEN role = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user name=' || replace(replace(regexp_replace(role, '([\\|<>])', '\\\1', 'g'), chr(10), '\n'), chr(13), '\r') || '|>' || chr(10) END AS head
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
),
r AS (SELECT *, head || text || '<|end|>' || chr(10) AS said FROM m),
o AS (SELECT *, CAST(sum(length(said)) OVER (PARTITION BY conv_id, speaker ORDER BY k) AS BIGINT) AS stop FROM r),
w AS (SELECT conv_id, speaker, string_agg(said, '' ORDER BY k) AS whole FROM o GROUP BY conv_id, speaker),
p AS (
  SELECT conv_id, speaker, (k - 1) // 512 AS part, CAST(min(stop - length(said)) AS BIGINT) AS start, max(stop) AS stop,
         coalesce(string_agg(CASE WHEN own THEN CAST(stop - length(said) + length(head) AS VARCHAR) || '-' || CAST(stop - 1 AS VARCHAR) END, ',' ORDER BY k), '') AS mask_spans,
         CAST(coalesce(sum(CASE WHEN own THEN length(said) - length(head) - 1 END), 0) AS BIGINT) AS mask_chars,
         count(*) AS n_turns, count(*) FILTER (WHERE own) AS own_turns
  FROM o GROUP BY ALL
)
SELECT p.conv_id, p.speaker, part, start, substr(whole, start + 1, stop - start) AS text, mask_spans, mask_chars, n_turns, own_turns
FROM p JOIN w ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.speaker = w.speaker
"""

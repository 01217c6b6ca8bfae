"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation again after every turn.  A turn's prefix hash is
the XOR of position-salted hashes of (role, text) over all turns up to it, kept
twice with different salts (128 bits together), so prefixes of any length come from running aggregates.  A
conversation whose last prefix hash is an inner prefix of another is a snapshot;
of equal ones the smallest id stays.  Anti-joins drop both kinds; what is left
is rendered.

A conversation may be of any length, and any number of its rows may share a
turn: rows are sorted by range over all tasks and numbered from the sizes of the
runs, cut into pieces of ``PIECE`` rows, and pieces are chained by their totals.
The rendering returns one row per piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import exclude, skew_join, stage

#: Rows per piece.
PIECE = 1024
_NO_ID = 2**63 - 1


def chat_markup(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n"))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv, piece, seq, role, text, x, y): distinct turns with their number
    from 0 and the prefix hashes up to them."""
    rows = turns.select(
        F.coalesce(F.col("conv").cast("long"), F.lit(_NO_ID)).alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(_NO_ID)).alias("turn"),
        "role", "text").distinct()
    # Distinct rows have no ties, so a partition's order is the same when it is made again.
    order = ["conv", "turn", "role", "text"]
    rows = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "sorted")
    runs = rows.groupBy("conv", "part").agg(F.min("at").alias("low"), F.count("*").alias("size"))
    earlier = F.sum("size").over(Window.partitionBy("conv").orderBy("part")) - F.col("size")
    runs = runs.select("conv", "part", (earlier - F.col("low")).alias("shift"))
    before = Window.partitionBy("conv").orderBy("piece")
    rows = stage(rows.join(runs, ["conv", "part"]).withColumn("seq", F.col("at") + F.col("shift")).select(
        "conv", F.floor(F.col("seq") / PIECE).alias("piece"), "seq", "role", "text",
        F.xxhash64(F.lit(1), "seq", F.col("role").isNull(), "role", F.col("text").isNull(), "text").alias("hx"),
        F.xxhash64(F.lit(2), "text", F.col("text").isNull(), "role", F.col("role").isNull(), "seq").alias("hy")), "turns")
    totals = rows.groupBy("conv", "piece").agg(F.bit_xor("hx").alias("tx"), F.bit_xor("hy").alias("ty"))
    chain = totals.select("conv", "piece",
                          F.bit_xor("tx").over(before).bitwiseXOR(F.col("tx")).alias("px"),
                          F.bit_xor("ty").over(before).bitwiseXOR(F.col("ty")).alias("py"))
    upto = Window.partitionBy("conv", "piece").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("rx", F.bit_xor("hx").over(upto)).withColumn("ry", F.bit_xor("hy").over(upto))
    return rows.join(chain, ["conv", "piece"]).select(
        "conv", "piece", "seq", "role", "text", F.col("rx").bitwiseXOR(F.col("px")).alias("x"), F.col("ry").bitwiseXOR(F.col("py")).alias("y"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv, n_turns) of the conversations that stay; ``turns`` as returned by
    ``numbered``."""
    ends = stage(turns.groupBy("conv").agg(F.max("seq").alias("last"), F.count("*").alias("rows")), "ends")
    marked = skew_join(turns, ends, ["conv"], "rows")
    inner = marked.filter("seq < last").select("seq", "x", "y").distinct()
    full = marked.filter("seq = last").groupBy("seq", "x", "y").agg(F.min("conv").alias("conv"))
    return full.join(inner, ["seq", "x", "y"], "left_anti").select("conv", (F.col("seq") + 1).alias("n_turns"))


def collapse_and_render(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                        text_col: str = "text", markup=chat_markup) -> DataFrame:
    """Rows (conversation id, ``segment``, ``n_turns``, ``text``) of the maximal
    conversations: ``text`` renders the turns of one piece in order, ``n_turns``
    counts the whole conversation, ``segment`` numbers the pieces from 0.

    Turns are ordered by turn, role, text; exactly repeated rows count once; a
    null turn is last; null role and text render as empty but differ from empty
    ones; all rows with a null id form one conversation, returned with null.  Of
    equal conversations the smallest id stays.  An empty table gives an empty
    result."""
    turns = stage(numbered(conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
                                                F.col(role_col).alias("role"), F.col(text_col).alias("text"))), "numbered")
    keep = stage(maximal(turns), "maximal")
    gone = turns.select("conv").distinct().join(keep, "conv", "left_anti")
    kept = exclude(turns, gone, ["conv"]).withColumn("line", markup(F.col("role"), F.col("text")))
    text = kept.groupBy("conv", "piece").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("t"))
    text = text.join(keep, "conv")
    order = Window.partitionBy("conv").orderBy("piece")
    return text.select(F.nullif("conv", F.lit(_NO_ID)).alias(conv_col), (F.row_number().over(order) - 1).cast("long").alias("segment"),
                       F.col("n_turns").cast("long").alias("n_turns"),
                       F.array_join(F.transform("t", lambda s: s["line"]), "").alias("text"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_and_render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations
), s AS (
  SELECT conv_id, row_number() OVER w AS seq, count(*) OVER (PARTITION BY conv_id) AS n,
         sha256(to_json(list({'r': role, 't': text}) OVER w)::VARCHAR) AS h,
         '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS line
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING)
), f AS (
  SELECT min(conv_id) AS conv_id, h FROM s WHERE seq = n GROUP BY h
), k AS (
  SELECT conv_id FROM f WHERE h NOT IN (SELECT h FROM s WHERE seq < n)
)
SELECT conv_id, 0::BIGINT AS segment, max(n) AS n_turns, string_agg(line, '' ORDER BY seq) AS text
FROM s JOIN k USING (conv_id) GROUP BY conv_id
"""

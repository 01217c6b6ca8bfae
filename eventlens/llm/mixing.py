"""Mixing sources to target weights by Pfair scheduling (built-in functions
only).

A source with ``parts`` a (its integer target weight) is cut into blocks of
``block`` documents.  Under the fluid schedule every source that has blocks left
advances in proportion to its parts; block k of a source starts when the virtual
time k/a is reached and ends at (k+1)/a.  In slots (one block each) that gives a
release time ``floor(t(k/a))`` and a deadline ``ceil(t((k+1)/a))``, with
``t(v)`` = sum over sources of min(a*v, blocks).  Earliest deadline first, ties
by source, places every block between its release and its deadline, so at any
slot every source is less than one block away from its fluid share, also after
other sources have run out.

At every whole virtual time all sources have finished whole blocks.  The
schedule therefore falls apart into independent rounds of at most sum(a) slots,
and all rounds in which the same sources have the same number of blocks are
alike: at most ``2 * sources + 1`` kinds of rounds are scheduled, each by a fold
over its slots, and every document looks its slot up.  No step walks the corpus
in order; ranks within a source come from counts of hash buckets, so a hot
source is spread over tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import skew_join, stage

#: Documents ranked in one group, on average, within a source.
BUCKET_ROWS = 20_000
#: The schedule is broadcast up to this many slots, else joined by shuffle.
BROADCAST_SLOTS = 2_000_000
#: The plan, a row per source with an entry for each, is broadcast up to this.
BROADCAST_SOURCES = 1000


def temperature_parts(counts: DataFrame, total: int = 100, alpha: float = 0.5) -> DataFrame:
    """Add ``parts``: target weights in proportion to ``n ** alpha``, as
    integers of at least 1 that sum to about ``total``."""
    power = F.pow(F.col("n").cast("double"), F.lit(alpha))
    everything = counts.groupBy().agg(F.collect_list(F.struct("source", "n", power.alias("p"))).alias("all"))
    whole = F.aggregate(F.transform(F.array_sort("all"), lambda x: x["p"]), F.lit(0.0), lambda a, x: a + x)
    return everything.withColumn("whole", whole).select("whole", F.explode("all").alias("x")).select(
        "x.source", "x.n", F.greatest(F.lit(1), F.round(F.lit(float(total)) * F.col("x.p") / F.col("whole"))).cast("long").alias("parts"))


def fixed_parts(counts: DataFrame, parts: dict[str, int], default: int = 1) -> DataFrame:
    """Add ``parts`` from a table of integer weights."""
    known = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]) if parts else None
    value = F.coalesce(F.try_element_at(known, F.col("source")), F.lit(default)) if parts else F.lit(default)
    return counts.withColumn("parts", value.cast("long"))


def _ranked(rows: DataFrame, total: int) -> DataFrame:
    """Add ``rank`` (from 0) within the source ``name``, in the order of (md5 of
    the id, id).  Buckets are leading digits of the md5, so their number changes
    where ranks are computed and not the ranks; rows move once, to their
    bucket."""
    digits = max(0, math.ceil(math.log(max(1, total / BUCKET_ROWS), 16)))
    rows = rows.withColumn("hi", F.substring("h", 1, digits // 2)).withColumn(
        "lo", F.substring("h", 1 + digits // 2, digits - digits // 2))
    lows = rows.groupBy("name", "hi", "lo").agg(F.count("*").alias("c"))
    highs = lows.groupBy("name", "hi").agg(F.sum("c").alias("c")).select(
        "name", "hi", (F.sum("c").over(Window.partitionBy("name").orderBy("hi")) - F.col("c")).alias("base"))
    lows = lows.withColumn("below", F.sum("c").over(Window.partitionBy("name", "hi").orderBy("lo")) - F.col("c"))
    starts = lows.join(highs, ["name", "hi"]).select("name", "hi", "lo", (F.col("base") + F.col("below")).alias("before"))
    place = F.row_number().over(Window.partitionBy("name", "hi", "lo").orderBy("h", "id"))
    return rows.withColumn("place", place).join(starts, ["name", "hi", "lo"]).withColumn(
        "rank", F.col("before") + F.col("place") - 1).drop("place", "before", "hi", "lo", "h")


def _fluid(all_: Column, k: Column, a: Column, up: bool) -> Column:
    """floor or ceil of t(k/a) in a round, for all = array of (a, m)."""
    total = F.aggregate(all_, F.lit(0).cast("long"), lambda s, x: s + F.least(x["a"] * k, x["m"] * a))
    rounded = total + a - 1 if up else total
    return ((rounded - F.pmod(rounded, a)) / a).cast("long")


def _plan(sources: DataFrame, block: int) -> DataFrame:
    """Per source: index, parts ``a``, ``blocks``, and for all: ``all`` (array
    of (a, blocks) by index) and ``breaks`` (first round of each kind)."""
    rows = sources.withColumn("blocks", F.ceil(F.col("n") / block))
    one = rows.groupBy().agg(F.array_sort(F.collect_list(F.struct("source", "n", "parts", "blocks"))).alias("s"))
    done = F.transform("s", lambda x: F.floor(x["blocks"] / x["parts"]))
    one = one.withColumn("all", F.transform("s", lambda x: F.struct(x["parts"].alias("a"), x["blocks"].alias("blocks")))) \
        .withColumn("breaks", F.array_sort(F.array_distinct(F.concat(
            F.array(F.lit(0).cast("long")), done, F.transform(done, lambda x: x + 1)))))
    return one.select("all", "breaks", F.posexplode("s").alias("i", "x")).select(
        "x.source", "x.n", F.col("x.parts").alias("a"), "x.blocks", "i", "all", "breaks")


def _schedule(plan: DataFrame) -> DataFrame:
    """(kind, i, k, off, release, deadline): within a round of a kind, the slot
    of block k of source i, by a fold over the slots."""
    kinds = plan.limit(1).select("all", F.posexplode("breaks").alias("kind", "c")).withColumn(
        "all", F.transform("all", lambda x: F.struct(
            x["a"].alias("a"),
            F.greatest(F.lit(0).cast("long"), F.least(x["a"], x["blocks"] - x["a"] * F.col("c"))).alias("m"))))
    window = F.transform("all", lambda x: F.transform(
        F.sequence(F.lit(0).cast("long"), x["m"]), lambda k: F.struct(
            _fluid(F.col("all"), k, x["a"], False).alias("r"), _fluid(F.col("all"), k + 1, x["a"], True).alias("d"))))
    kinds = kinds.withColumn("win", window).withColumn(
        "slots", F.aggregate("all", F.lit(0).cast("long"), lambda s, x: s + x["m"])).filter("slots > 0")
    fold = """
      aggregate(sequence(0L, slots - 1),
        named_struct('nxt', transform(all, x -> 0L), 'out', cast(array() as array<struct<i:int,k:bigint>>)),
        (st, t) -> transform(array(array_min(filter(
              transform(all, (x, i) -> named_struct('d', win[i][cast(st.nxt[i] as int)].d, 'i', i)),
              y -> st.nxt[y.i] < all[y.i].m and win[y.i][cast(st.nxt[y.i] as int)].r <= t))),
            b -> named_struct('nxt', transform(st.nxt, (v, i) -> v + if(i = b.i, 1L, 0L)),
                              'out', array_append(st.out, named_struct('i', b.i, 'k', st.nxt[b.i]))))[0],
        st -> st.out)"""
    return kinds.select("kind", "win", F.posexplode(F.expr(fold)).alias("off", "o")).select(
        "kind", F.col("o.i").alias("i"), F.col("o.k").alias("k"), "off",
        F.col("win")[F.col("o.i")][F.col("o.k").cast("int")]["r"].alias("r"),
        F.col("win")[F.col("o.i")][F.col("o.k").cast("int")]["d"].alias("d"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weigh=temperature_parts,
        block: int = 8, carry: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, source, ``source_rank``, ``block_no``,
    ``release``, ``deadline``, ``slot`` and ``position`` (slot * block + place in
    the block), which orders the mix; with ``carry`` also the whole input row as
    struct ``doc``.

    ``weigh`` adds integer ``parts`` to a frame (source, n).  Nothing is
    dropped: when a source runs out, the others go on in proportion.  A null
    source is a source of its own; null ids come first within their source;
    repeated rows take consecutive places; an empty table gives an empty
    result."""
    picked = [F.col(id_col).alias("id"), F.col(source_col).alias("source")]
    if carry:
        picked.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = docs.select(*picked).withColumn("h", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")))
    counts = docs.select(F.col(source_col).alias("source")).groupBy("source").agg(F.count("*").alias("n"))
    plan = stage(_plan(weigh(counts), block), "plan")
    schedule = stage(_schedule(plan), "schedule")
    total, sources, bound = plan.agg(F.sum("n"), F.count("*"), (2 * F.count("*") + 1) * F.sum("a")).first()
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))  # a join key without null
    ranked = _ranked(rows.withColumn("name", name), total or 0)
    plan = plan.withColumn("name", name).drop("source")
    ranked = ranked.join(F.broadcast(plan), "name") if sources <= BROADCAST_SOURCES else skew_join(ranked, plan, ["name"], "n")
    rank, a = F.col("rank"), F.col("a")
    block_no = ((rank - rank % block) / block).cast("long")
    ranked = ranked.withColumn("block_no", block_no).withColumn("k", F.col("block_no") % a)
    ranked = ranked.withColumn("round", ((F.col("block_no") - F.col("k")) / a).cast("long"))
    ranked = ranked.withColumn("kind", F.size(F.filter("breaks", lambda x: x <= F.col("round"))) - 1)
    base = F.aggregate("all", F.lit(0).cast("long"), lambda s, x: s + F.least(x["a"] * F.col("round"), x["blocks"]))
    ranked = ranked.withColumn("base", base).drop("all", "breaks")
    if (bound or 0) <= BROADCAST_SLOTS:
        schedule = F.broadcast(schedule)
    slot = F.col("base") + F.col("off")
    out = ranked.join(schedule, ["kind", "i", "k"]).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), rank.alias("source_rank"), "block_no",
        (F.col("base") + F.col("r")).alias("release"), (F.col("base") + F.col("d")).alias("deadline"),
        slot.alias("slot"), (slot * block + rank % block).alias("position"), *(["doc"] if carry else []))
    return out


def interleave(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with their columns, in the order of the mix: sorted
    by position within and across partitions."""
    mixed = mix(docs, carry=True, **options).select("doc", "position")
    return mixed.repartitionByRange("position").sortWithinPartitions("position").select("doc.*")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH RECURSIVE cnt AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), src AS (
  SELECT source, n, row_number() OVER (ORDER BY source NULLS FIRST) AS i,
         greatest(1, round(100.0::DOUBLE * sqrt(n::DOUBLE) / sum(sqrt(n::DOUBLE)) OVER ()))::BIGINT AS a,
         (n + 7) // 8 AS blocks
  FROM cnt
), chunk AS (
  SELECT c, sum(least(a * c, blocks))::BIGINT AS base, sum(greatest(0, least(a, blocks - a * c)))::BIGINT AS slots,
         list(a ORDER BY i) AS aa, list(greatest(0, least(a, blocks - a * c)) ORDER BY i) AS mm
  FROM src, unnest(range(0, (SELECT max(blocks // a) + 1 FROM src))) AS u(c)
  GROUP BY c
), job AS (
  SELECT h.c, s.i, k,
         sum(least(o.a * k, h.mm[o.i] * s.a))::BIGINT // s.a AS r,
         (sum(least(o.a * (k + 1), h.mm[o.i] * s.a))::BIGINT + s.a - 1) // s.a AS d
  FROM chunk h JOIN src s ON true, unnest(range(0, h.mm[s.i])) AS u(k), src o
  GROUP BY h.c, s.i, s.a, k
), win AS (
  SELECT c, list({'i': i, 'k': k, 'r': r, 'd': d} ORDER BY d, i) AS jobs FROM job GROUP BY c
), sim AS (
  SELECT c, 0::BIGINT AS t, jobs, NULL::STRUCT(i BIGINT, k BIGINT, r BIGINT, d BIGINT) AS pick FROM win
  UNION ALL
  SELECT c, t + 1, list_filter(jobs, lambda x: x <> p), p
  FROM (SELECT c, t, jobs, list_filter(jobs, lambda x: x.r <= t)[1] AS p FROM sim WHERE len(jobs) > 0)
), ranked AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS rank FROM documents
)
SELECT r.doc_id, r.source, r.rank AS source_rank, r.rank // 8 AS block_no,
       h.base + (m.pick).r AS release, h.base + (m.pick).d AS deadline, h.base + m.t - 1 AS slot,
       (h.base + m.t - 1) * 8 + r.rank % 8 AS position
FROM ranked r JOIN src s ON r.source IS NOT DISTINCT FROM s.source
JOIN chunk h ON h.c = (r.rank // 8) // s.a
JOIN sim m ON m.c = h.c AND (m.pick).i = s.i AND (m.pick).k = (r.rank // 8) % s.a
"""

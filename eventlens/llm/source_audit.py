"""Source divergence audit: how far the sources of a language differ in their
terms, and which terms mark a source.

1. *Partial counts*, an Arrow pipeline inside ``mapInArrow``: ``ascii_lower``,
   ``split_pattern_regex``, ``dictionary_encode`` and a hash ``group_by`` count
   the occurrences and the documents of every (language, source, term).  A task
   merges the counts of its slices of text and sends them on when they reach
   ``FLUSH_ROWS``, so memory follows neither the partition nor a hot source.
2. *Merge*: Spark adds the partial counts per (language, source, term), then
   sees all sources of a (language, term) side by side, which gives the term's
   document count and its count in the whole language.  Terms below
   ``min_docs`` documents go.
3. *Columnar shards*: the kept terms of a language are dealt by hash into
   shards of a bounded number of cells (terms x sources).  A shard becomes a
   matrix of probabilities; it gives its share of the divergence of every two
   sources, and the first terms of each source.  Shares are added by Spark.

Everything is integer arithmetic: probabilities are counted in billionths from
decimals, differences stay below 2**63.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import skew_join, stage

#: What separates terms: every ASCII character that is no letter (fixed value).
SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Probabilities are counted in billionths; every count is smoothed by 2.
SCALE, SMOOTH = 1_000_000_000, 2
MIN_DOCS, TOP_TERMS = 10, 10
#: Text handled at once, and counts held, by a counting task.
SLICE_BYTES, FLUSH_ROWS = 1 << 20, 400_000
#: Cells (terms x sources) of a shard, but this many terms at least.
CELLS, SHARD_TERMS = 1 << 16, 1000

_COUNTS = "lang string, source string, term string, n long, docs long"


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with a bounded amount of text; a longer text is alone."""
    sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - sizes[lo] + SLICE_BYTES, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _count_slice(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of one slice; a null term stands for the
    group itself, with its number of documents."""
    groups = pa.table([batch.column("lang"), batch.column("source")], names=["lang", "source"])
    found = groups.group_by(["lang", "source"]).aggregate([([], "count_all")])
    lists = pc.split_pattern_regex(pc.ascii_lower(batch.column("text")), SEPARATORS)
    terms, doc = lists.flatten(), pc.list_parent_indices(lists)
    real = pc.not_equal(terms, "")
    terms, doc = terms.filter(real), doc.filter(real)
    coded = terms.dictionary_encode()
    per_doc = pa.table([doc, coded.indices], names=["doc", "code"]).group_by(["doc", "code"]).aggregate([([], "count_all")])
    rows = pa.table([batch.column("lang").dictionary_encode().take(per_doc["doc"]),
                     batch.column("source").dictionary_encode().take(per_doc["doc"]),
                     per_doc["code"], per_doc["count_all"]], names=["lang", "source", "code", "n"])
    out = rows.group_by(["lang", "source", "code"]).aggregate([("n", "sum"), ([], "count_all")])
    return pa.concat_tables([
        pa.table([out["lang"].cast(pa.string()), out["source"].cast(pa.string()),
                  coded.dictionary.take(out["code"]), out["n_sum"], out["count_all"]],
                 names=["lang", "source", "term", "n", "docs"]),
        pa.table([found["lang"], found["source"], pa.nulls(len(found), pa.string()),
                  pa.array(np.zeros(len(found), np.int64)), found["count_all"]],
                 names=["lang", "source", "term", "n", "docs"])])


def _merged(parts: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(parts).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return out.rename_columns(["lang", "source", "term", "n", "docs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, rows = [], 0
    for batch in batches:
        for piece in _slices(batch):
            parts.append(_count_slice(piece))
            rows += len(parts[-1])
            if rows >= FLUSH_ROWS:
                parts = [_merged(parts)]
                rows = len(parts[0])
                if rows >= FLUSH_ROWS // 2:
                    yield from parts[0].to_batches(max_chunksize=20_000)
                    parts, rows = [], 0
    if parts:
        yield from _merged(parts).to_batches(max_chunksize=20_000)


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group, and the
    documents that hold it; term null: the documents of the group."""
    blank = F.lit("")
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), blank).alias("lang"),
                       F.coalesce(F.col(source_col).cast("string"), blank).alias("source"),
                       F.coalesce(F.col(text_col), blank).alias("text"))
    return rows.mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(count: str | Column, total: str | Column, terms: str | Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exactly."""
    def wide(c):
        return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")
    above = (F.lit(SCALE).cast("decimal(10,0)") * (wide(count) + F.lit(SMOOTH))).cast("decimal(38,0)")
    below = (wide(total) + wide(terms) * F.lit(SMOOTH)).cast("decimal(38,0)")
    return F.lit(1).cast("long") + F.call_function("div", above, below)


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


_SHARES = "a long, b long, item string, value long"


def _shard(key, cells: pa.Table, groups: pa.Table) -> pa.Table:
    """Shares of one shard: rows (a, b, null, share) for every two sources
    a < b of the language, and (a, null, term, value) for the first terms of a.
    ``cells``: no, term, n, p, q for every source that holds a term; ``groups``:
    no, p0 for every source, p0 being the probability of an absent term."""
    order = np.argsort(groups["no"].to_numpy())
    base = groups["p0"].to_numpy()[order]
    coded = cells["term"].combine_chunks().dictionary_encode()
    row, no = coded.indices.to_numpy(), cells["no"].to_numpy()
    p, q = cells["p"].to_numpy(), cells["q"].to_numpy()
    matrix = np.repeat(base[:, None], len(coded.dictionary), axis=1)
    matrix[no, row] = p
    a, b, share = [], [], []
    for i in range(len(base) - 1):
        share.append(_divergence(matrix[i + 1:], matrix[i]).sum(axis=1))
        a.append(np.full(len(base) - 1 - i, i, np.int64))
        b.append(np.arange(i + 1, len(base), dtype=np.int64))
    empty = [np.zeros(0, np.int64)]
    pairs = pa.table([np.concatenate(a or empty), np.concatenate(b or empty),
                      pa.nulls(sum(map(len, a)), pa.string()), np.concatenate(share or empty)], names=["a", "b", "item", "value"])
    above = np.flatnonzero((p > q) & (cells["n"].to_numpy() > 0))
    terms = pa.table([pa.array(no[above].astype(np.int64)), cells["term"].combine_chunks().take(pa.array(above)),
                      pa.array(_divergence(p[above], q[above]))], names=["a", "item", "value"])
    terms = terms.sort_by([("a", "ascending"), ("value", "descending"), ("item", "ascending")])
    who = terms["a"].to_numpy()
    terms = terms.filter(pa.array(np.arange(len(who)) - np.searchsorted(who, who) < TOP_TERMS))
    firsts = pa.table([terms["a"], pa.nulls(len(terms), pa.int64()), terms["item"].cast(pa.string()), terms["value"]],
                      names=["a", "b", "item", "value"])
    return pa.concat_tables([pairs, firsts])


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` holds the
    divergence of a source from each other source of its language, part
    ``term`` the first ten terms that are likelier in the source than in the
    language.

    Null text, language or source counts as ''.  A term is a run of letters and
    non-ASCII characters, only A-Z lower-cased.  Repeated rows count as often as
    they occur; ties rank by item (UTF-8).  A language without a kept term gives
    pairs of value 0, one with a single source no pair; an empty table gives an
    empty result.  Texts are read whole, slice by slice.  A shard's matrix has a
    row per source of the language, and the result a row per two sources: the
    sources of a language are taken to number thousands, not millions."""
    counts = stage(term_counts(docs, text_col, lang_col, source_col), "counts")
    over = Window.partitionBy("lang", "term")
    kept = counts.filter("term is not null").withColumn("in_docs", F.sum("docs").over(over)) \
        .withColumn("n_lang", F.sum("n").over(over)).filter(F.col("in_docs") >= min_docs)
    kept = stage(kept.select("lang", "source", "term", "n", "n_lang"), "kept")

    # One row per group: its number ``no`` in the language, the totals of group
    # and language, the kept terms of the language and its sources.
    per_lang = kept.groupBy("lang", "term").agg(F.first("n_lang").alias("n_lang")).groupBy("lang").agg(
        F.count("*").alias("terms"), F.sum("n_lang").alias("lang_total"))
    filled = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("cells"))
    no = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")
    zero = F.lit(0).cast("long")
    groups = counts.filter("term is null").select("lang", "source").join(filled, ["lang", "source"], "left") \
        .join(per_lang, "lang", "left").select(
            "lang", "source", no.alias("no"), F.count("*").over(Window.partitionBy("lang")).alias("sources"),
            *[F.coalesce(c, zero).alias(c) for c in ("total", "cells", "terms", "lang_total")])
    least = F.greatest(F.lit(SHARD_TERMS), F.floor(F.lit(CELLS) / F.col("sources")))
    groups = groups.withColumn("shards", F.ceil(F.col("terms") / least)) \
        .withColumn("p0", F.when(F.col("terms") > 0, probability(zero, "total", "terms")))
    groups = stage(groups, "groups")

    cells = skew_join(kept, groups.filter("cells > 0"), ["lang", "source"], "cells").select(
        "lang", F.pmod(F.xxhash64("term"), F.col("shards")).cast("long").alias("shard"), "no", "term", "n",
        probability("n", "total", "terms").alias("p"), probability("n_lang", "lang_total", "terms").alias("q"))
    every = groups.filter("shards > 0").select(   # new names: cells hold the groups' columns as well
        F.col("lang").alias("lang"), F.explode(F.sequence(zero, F.col("shards") - 1)).alias("shard"),
        F.col("no").alias("no"), F.col("p0").alias("p0"))
    shares = cells.groupBy("lang", "shard").cogroup(every.groupBy("lang", "shard")).applyInArrow(
        lambda key, left, right: _labelled(key, _shard(key, left, right)), f"lang string, {_SHARES}")
    shares = stage(shares, "shares")

    # A language without a kept term has no shard; its pairs are 0.
    names = groups.select("lang", F.col("no").alias("a"), "source")
    sums = shares.filter("b is not null").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sums = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    bare = groups.filter("shards = 0").select("lang", F.col("no").alias("a"), F.explode(
        F.sequence(zero, F.col("sources") - 1)).alias("b")).filter("a != b").withColumn("value", zero)
    pairs = sums.unionByName(bare).join(names, ["lang", "a"]).join(
        names.withColumnsRenamed({"a": "b", "source": "item"}), ["lang", "b"]).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value")
    terms = shares.filter("b is null").join(names, ["lang", "a"]).select(
        "lang", "source", F.lit("term").alias("part"), "item", "value")
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    first = terms.withColumn("rank", place).filter(F.col("rank") <= TOP_TERMS)
    return pairs.withColumn("rank", place).unionByName(first)


def _labelled(key, table: pa.Table) -> pa.Table:
    lang = pa.array([key[0].as_py()] * len(table), pa.string())
    return table.add_column(0, "lang", lang)


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), w AS (
  SELECT row, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT row) >= 10
), c AS (
  SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL
), l AS (
  SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL
), v AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n) AS total FROM l GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), gt AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT l.lang, gt.source, l.term, coalesce(c.n, 0) AS n,
         (1 + (1000000000 * (coalesce(c.n, 0)::HUGEINT + 2)) // (gt.total + 2 * v.v))::BIGINT AS p,
         (1 + (1000000000 * (l.n + 2)) // (v.total + 2 * v.v))::BIGINT AS q
  FROM l JOIN v USING (lang) JOIN gt USING (lang) LEFT JOIN c ON c.lang = l.lang AND c.source = gt.source AND c.term = l.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM r QUALIFY part = 'pair' OR rank <= 10
"""

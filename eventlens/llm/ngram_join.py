"""N-gram Jaccard similarity join: rare-first prefix filtering.

Documents with equal shingle sets form a class; from then on one set per class
is used.  All thresholds are integer ratios, so no rounding decides a link.

1. *Survivors.*  Under any fixed order of shingles, two sets with overlap at
   least ``a`` share their first ``c`` common shingles within the first
   ``n - a + c`` of each.  With the order of the hashes, a class whose leading
   part does not hold ``c`` shingles that occur in another leading part has no
   partner.  This drops most documents before any frequency is counted.
2. *Rare first.*  Frequencies of all shingles of the survivors order each set;
   only the prefix ``n - a + 1`` is posted, without shingles nobody else has.
3. *Candidates.*  Members of a posting list are compared with a few pivots per
   list and round (more each round) under the length and positional filters.
   Members already connected are not compared again, so a group of m near
   copies costs about m comparisons, not m squared.  A list is finished when
   every member outside its largest component has been a pivot: then every
   pair of the list has been compared or is known to be connected.
4. *Verification*, once per pair: suffix filter, then the exact overlap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, exclude, prefilter, skew_join, stage
from .words import slices, window_hashes

#: The leading part is longer than the plain prefix by one in EXTRA of the set.
EXTRA = 10
#: Pivots per list in the first round, and growth per round.
PIVOTS, GROWTH = 2, 8
#: With at most this many (pivot, member) pairs left to filter, or 50 per member,
#: all remaining members become pivots in one round; hash range that gives each
#: its own place.
MANY, ALL = 200_000, 1 << 24
#: Comparisons that share one copy of a pivot's set.
FAN = 200
_NO_ID = 2**63 - 1


def shingle_sets(text: pa.Array, k: int):
    """For each slice of texts: (rows, sets), a set being its distinct shingle
    hashes in ascending order; a text with fewer than k words has its whole
    sequence as the one shingle, one without words an empty set."""
    for words in slices(text, lower=True):
        first = words.first
        size = np.diff(first)
        hashes = window_hashes(words.keys, k)
        doc = np.repeat(np.arange(len(size)), size)[:len(hashes)]
        start = np.arange(len(hashes))
        whole = start + k <= first[doc + 1]
        hashes, doc = hashes[whole], doc[whole]
        order = np.lexsort((hashes, doc))
        hashes, doc = hashes[order], doc[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        hashes, doc = hashes[new], doc[new]
        bound = np.searchsorted(doc, np.arange(len(size) + 1))
        sets = [hashes[a:b] for a, b in zip(bound[:-1], bound[1:])]
        for i in np.flatnonzero((size > 0) & (size < k)):
            sets[i] = window_hashes(words.keys[first[i]:first[i + 1]], int(size[i]), seed=1)
        yield words.rows, sets


def _signature(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63


def _lists(parts: list[np.ndarray], type_) -> pa.Array:
    at = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat)).cast(type_)


def _leading(k: int, num: int, den: int):
    def run(batches):
        for batch in batches:
            for rows, sets in shingle_sets(batch.column(2), k):
                lead = []
                for s in sets:
                    n = len(s)
                    lead.append(s[:n - (num * n + den - 1) // den + max(1, -(-n // EXTRA))])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(rows.start, len(sets)), batch.column(1).slice(rows.start, len(sets)),
                    pa.array(map(len, sets), pa.int32()),
                    pa.array([_signature(s) if len(s) else None for s in sets], pa.int64()),
                    _lists(lead, pa.list_(pa.int64()))], names=["id", "tag", "n", "sig", "lead"])
    return run


def _full(k: int):
    def run(batches):
        for batch in batches:
            for _, sets in shingle_sets(batch.column(2), k):
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(map(_signature, sets), pa.int64()), pa.array(map(len, sets), pa.int32()),
                    _lists(sets, pa.list_(pa.int64()))], names=["sig", "n", "toks"])
    return run


def suffix_distance(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """Lower bound of the symmetric difference of two sorted sets: split both
    at the middle element of the second and add up the length differences."""
    if depth == 0 or len(x) == 0 or len(y) == 0:
        return abs(len(x) - len(y))
    mid = len(y) // 2
    cut = int(np.searchsorted(x, y[mid]))
    return suffix_distance(x[:cut], y[:mid], depth - 1) + suffix_distance(x[cut:], y[mid:], depth - 1)


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether den * |x and y| >= num * |x or y|, for ascending arrays."""
    need = -(-num * (len(x) + len(y)) // (num + den))
    if suffix_distance(x, y) > len(x) + len(y) - 2 * need:
        return False
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    both = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))
    return den * both >= num * (len(x) + len(y) - both)


def _verify(num: int, den: int):
    def run(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            xo, yo = x.offsets.to_numpy(), y.offsets.to_numpy()
            xv = x.values.to_numpy().view(np.uint64)
            yv = y.values.to_numpy().view(np.uint64)
            ok = [linked(xv[xo[i]:xo[i + 1]], yv[yo[i]:yo[i + 1]], num, den) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def _postings(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(tok, sig, n, pos): the shared shingles of each set's rare-first prefix;
    pos counts the shingles up to and including this one in that order."""
    toks = sets.select("sig", "n", F.explode("toks").alias("tok"))
    freq = stage(toks.groupBy("tok").agg(F.count("*").alias("df")).filter("df > 1"), "freq")
    shared = skew_join(toks, freq, ["tok"], "df").groupBy("sig", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("s"))
    alone = F.col("n") - F.size("s")
    prefix = F.expr(f"cast(n - ({num} * n + {den - 1}) div {den} + 1 as int)")
    return shared.select("sig", "n", alone.alias("alone"), F.posexplode(
        F.slice("s", F.lit(1), F.greatest(prefix - alone, F.lit(0)))).alias("i", "t")).select(
        F.col("t.tok").alias("tok"), "sig", "n", (F.col("alone") + F.col("i") + 1).alias("pos"))


def _viable(posts: DataFrame, num: int, den: int) -> DataFrame:
    """Without members that the positional filter keeps from all others of
    their list, the shortest included, and without lists of one."""
    lists = posts.groupBy("tok").agg(F.count("*").alias("members"), F.min("n").alias("least_n"))
    lists = stage(lists.filter("members > 1"), "lists")
    return skew_join(posts, lists, ["tok"], "members").filter(
        f"{num + den} * (1 + n - pos) >= {num} * (n + greatest(least_n, ({num} * n + {den - 1}) div {den}))").select(
        "tok", "sig", "n", "pos")


def _passes(num: int, den: int) -> str:
    """Length and positional filters between a member (n, pos) and a pivot p.
    Linked sets meet first in a shingle that is in both prefixes; in its list,
    besides it only what follows it can be shared."""
    return (f"p.sig <> sig and p.comp <> comp and {den} * least(n, p.n) >= {num} * greatest(n, p.n) and "
            f"{num + den} * (1 + least(n - pos, p.n - p.pos)) >= {num} * (n + p.n)")


def _round(posts: DataFrame, comp: DataFrame | None, used: DataFrame | None, pivots: int, num: int, den: int):
    """Candidate pairs and pivots of one round: staged (tok, pivot) and pairs
    (a, b), b a pivot."""
    if comp is None:
        members = posts.withColumn("comp", F.col("sig"))
    else:
        members = posts.join(comp.withColumnRenamed("node", "sig"), "sig", "left").withColumn(
            "comp", F.coalesce("component", "sig")).drop("component")
    if used is not None:
        members = members.join(used, ["tok", "sig"], "left_anti")
    members = stage(members, "members")
    lists = members.groupBy("tok", "comp").agg(F.count("*").alias("c")).groupBy("tok").agg(
        F.sum("c").alias("members"), F.count("*").alias("comps"), F.max(F.struct("c", "comp")).alias("top"))
    lists = stage(lists.filter("comps > 1").select("tok", "members", "top.comp", "top.c").withColumnsRenamed(
        {"comp": "top", "c": "largest"}), "lists")
    total, work = lists.agg(F.sum("members"), F.sum(F.col("members") * (F.col("members") - F.col("largest")))).first()
    if not total:
        return None
    if comp is not None and work <= max(MANY, 50 * total):
        pivots = ALL  # few are left outside the largest components: ask them all at once
    lists = lists.drop("largest")
    members = skew_join(members, lists, ["tok"], "members")
    asking = members if comp is None else members.filter("comp <> top")
    chosen = asking.groupBy("tok", "members", F.pmod(F.xxhash64("sig", F.lit(pivots)), F.lit(pivots)).alias("s")).agg(
        F.min(F.struct("pos", "n", "sig", "comp")).alias("p"))
    chosen = stage(chosen.groupBy("tok", "members").agg(F.collect_list("p").alias("ps")), "pivots")
    pairs = skew_join(members.drop("members"), chosen, ["tok"], "members").withColumn(
        "ps", F.expr(f"filter(ps, p -> {_passes(num, den)})")).select("sig", F.explode("ps").alias("p"))
    pairs = pairs.select(F.least("sig", "p.sig").alias("lo"), F.greatest("sig", "p.sig").alias("hi"),
                         F.col("p.sig").alias("b")).groupBy("lo", "hi").agg(F.min("b").alias("b"))
    pairs = pairs.select((F.when(F.col("b") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))).alias("a"),
                         "b", "lo", "hi")
    return chosen.select("tok", F.explode("ps.sig").alias("sig")), pairs


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that really link.  A pivot's set is copied once per FAN
    comparisons, so one pivot's many partners are spread over tasks."""
    many = stage(pairs.groupBy("b").agg(F.count("*").alias("c")), "partners")
    fan = F.floor((F.col("c") - 1) / FAN).cast("int")
    asked = skew_join(pairs.select("a", "b"), many, ["b"], "c").select(
        "a", "b", F.pmod(F.xxhash64("a"), fan + 1).cast("int").alias("salt"))
    held = sets.join(many, sets.sig == many.b).select(
        "b", F.col("toks").alias("y"), F.explode(F.sequence(F.lit(0), fan)).alias("salt"))
    both = asked.join(sets.select(F.col("sig").alias("a"), F.col("toks").alias("x")), "a").join(
        held, ["b", "salt"]).select("a", "b", "x", "y")
    return both.mapInArrow(_verify(num, den), "a long, b long")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Staged, one row per row of ``docs``: ``id`` (a null as the largest
    number), ``tag`` (hash of the text, tells rows that share an id apart),
    ``n`` shingles, ``grp`` (a number per connected group, null without
    shingles) and ``low``, the smallest id of the group."""
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"),
                         F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    rows = stage(source.mapInArrow(_leading(words, num, den), "id long, tag long, n int, sig long, lead array<long>"), "leading")
    some = rows.filter("n > 0")
    classes = stage(some.groupBy("sig").agg(F.min("id").alias("first"), F.count("*").alias("copies")), "classes")
    member = stage(skew_join(some.select("id", "tag", "n", "sig"), classes, ["sig"], "copies"), "member")

    copies = member.filter("id <> first").select("id", "sig").distinct()
    alive = stage(_survivors(exclude(some, copies, ["id", "sig"]), num, den).join(classes, "sig").select(
        "sig", F.col("first").alias("id")), "alive")
    sets = prefilter(source, alive, "id").mapInArrow(_full(words), "sig long, n int, toks array<long>")
    sets = stage(sets.join(alive.select("sig"), "sig", "left_semi").dropDuplicates(["sig"]), "sets")
    comp = _connect(sets, num, den)

    out = member.select("id", "tag", "n", F.col("sig").alias("grp"), F.col("first").alias("low"))
    if comp is not None:
        low = comp.join(classes, comp.node == classes.sig).select("sig", "component", "first", "copies")
        low = low.join(low.groupBy("component").agg(F.min("first").alias("low")), "component")
        low = stage(low.select("sig", "component", "low", "copies"), "components")
        out = skew_join(member.select("id", "tag", "n", "sig", "first"), low, ["sig"], "copies", "left").select(
            "id", "tag", "n", F.coalesce("component", "sig").alias("grp"), F.coalesce("low", "first").alias("low"))
    none = rows.filter("n = 0").select("id", "tag", "n", "sig", F.col("id").alias("low")).withColumnRenamed("sig", "grp")
    return stage(out.unionByName(none), "groups")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles`` (distinct ``words``-word
    shingles of the A-Z lower-cased text) and ``component_id``, the smallest id
    reachable by links; two documents link when
    ``den * |intersection| >= num * |union|``.

    Null and wordless texts have no shingle and link with nothing, themselves
    apart; rows that repeat an id are documents of their own that share it; a
    null id is the largest and is returned as null.  Shingles and sets are
    compared by 64-bit hashes.  An empty table gives an empty result."""
    null = F.lit(_NO_ID)
    return jaccard_groups(docs, id_col, text_col, words, num, den).select(
        F.nullif("id", null).alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.nullif("low", null).alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that stay when every connected group keeps the one
    with the smallest id (ties: the smaller hash of the text; rows equal in
    both are one document and stay together)."""
    groups = jaccard_groups(docs, id_col, text_col, words, num, den).filter("grp is not null")
    best = stage(groups.groupBy("grp").agg(F.min(F.struct("id", "tag")).alias("best"), F.count("*").alias("rows")).filter("rows > 1"), "best")
    gone = stage(skew_join(groups, best, ["grp"], "rows").filter(F.struct("id", "tag") != F.col("best")).select("id", "tag").distinct(), "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                       F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text_col).alias("tag"))
    return exclude(rows, gone, ["id", "tag"]).select("doc.*")


def _survivors(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Classes whose leading part can hold the shingles a partner would share."""
    lead = rows.select("sig", "n", F.explode("lead").alias("tok"))
    shared = stage(lead.groupBy("tok").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
    need = F.expr(f"greatest(1, ({num} * n) div {den * EXTRA})")
    return skew_join(lead, shared, ["tok"], "df").groupBy("sig", "n").agg(F.count("*").alias("c")).filter(
        F.col("c") >= need).select("sig")


def _connect(sets: DataFrame, num: int, den: int) -> DataFrame | None:
    """(node, component) over the links of ``sets``; None without any link."""
    posts = stage(_viable(stage(_postings(sets, num, den), "postings"), num, den), "viable")
    comp = used = tested = links = None
    pivots = PIVOTS
    while (found := _round(posts, comp, used, pivots, num, den)) is not None:
        chosen, pairs = found
        if tested is not None:
            pairs = pairs.join(tested, ["lo", "hi"], "left_anti")
        pairs = stage(pairs, "pairs")
        new = stage(_links(pairs, sets, num, den), "links")
        tested = pairs.select("lo", "hi") if tested is None else tested.union(pairs.select("lo", "hi"))
        used = chosen if used is None else used.union(chosen)
        if not new.isEmpty():
            links = new if links is None else links.union(new)
            comp = stage(components(links), "component")
        elif comp is None:
            comp = posts.limit(0).select(F.col("sig").alias("node"), F.col("sig").alias("component"))
        pivots *= GROWTH
    return comp


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, num=90, den=100)


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ')
                               ELSE array_to_string(ws[i:i + 2], ' ') END AS g
  FROM w, unnest(range(1, greatest(len(ws) - 1, 2))) AS u(i) WHERE len(ws) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), linked AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
       JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM n
  UNION
  SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(min(r.b), d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN reach r ON r.a = d.doc_id
GROUP BY d.doc_id, n.n
"""

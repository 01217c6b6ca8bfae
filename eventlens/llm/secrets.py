"""Secret scan: the rules' patterns are compiled into one minimised automaton
(``automaton``), which reads every byte once and reports where a match of a
rule ends.  Only there a second automaton, of the reversed pattern, runs back to
the start of the match, and one of the rule's head forward to its value.

No shuffle, no state between texts: a task's memory follows one slice of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import END, Matcher, Search

SLICE_BYTES = 1 << 20


@dataclass(frozen=True)
class Rule:
    """``head`` then ``counted`` or more characters of ``tail``.  A match with
    fewer than ``least`` of them is dropped, but has used up its text."""
    kind: str
    head: str
    tail: str
    least: int
    counted: int = 1
    ignore_case: bool = False

    @property
    def pattern(self) -> str:
        return f"{self.head}{self.tail}{{{self.counted},}}"


# Fixed values.  The first three are the base rules.  A hexadecimal run has no
# head: counting its first eight characters in the automaton keeps words of
# letters a to f from being reported; what is left out is a shorter run, which
# holds no longer one.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", 6,
         ignore_case=True),
    Rule("access", "AKIA", "[A-Z0-9]", 16),
    Rule("hex", "", "[0-9a-f]", 24, counted=8),
)
MORE = (
    Rule("github", "gh[opsru]_", "[A-Za-z0-9]", 36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", 20),
    Rule("google", "AIza", "[A-Za-z0-9_-]", 35),
    Rule("stripe", "[rs]k_live_", "[A-Za-z0-9]", 16),
)


class Scanner:
    """The compiled rules; built once per task."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.search = Search([(r.pattern, r.ignore_case) for r in rules])
        self.back = [Matcher(r.pattern, r.ignore_case, backwards=True) for r in rules]
        self.head = [Matcher(r.head, r.ignore_case) for r in rules]

    def spans(self, data: bytes, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes of ``data``, which holds texts back to
        back; ``offsets`` are their bounds."""
        raw = np.frombuffer(data, np.uint8)
        # one END after every text; texts are then further apart by one
        stream = np.full(len(raw) + len(offsets) - 1, END, np.uint16)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        stream[np.arange(len(raw)) + text] = raw
        shifted = offsets[:-1] + np.arange(len(offsets) - 1)
        found, used = [], [0] * len(self.rules)
        for end, r in self.search.ends(stream):
            t = int(np.searchsorted(shifted, end - 1, "right")) - 1
            end -= t
            low = max(used[r], int(offsets[t]))
            start = end - self.back[r].longest(_backwards(raw, low, end))
            used[r] = end
            value = self.head[r].longest(_forwards(raw, start, end))
            if end - start - value >= self.rules[r].least:
                found.append((start, r, end))
        return sorted(found)


def _backwards(raw: np.ndarray, low: int, end: int, step: int = 256):
    """Bytes from ``end`` down to ``low``, a few at a time."""
    while end > low:
        at = max(low, end - step)
        yield from raw[at:end][::-1].tolist()
        end = at


def _forwards(raw: np.ndarray, at: int, end: int, step: int = 256):
    while at < end:
        yield from raw[at:min(end, at + step)].tolist()
        at += step


def _digest(spans: list[str]) -> str:
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


_FOUND = "id long, spans array<struct<kind:string,start:long,end:long>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """One row per row of ``docs``: id and ``spans``, an array of (kind, start,
    end) in code points, end exclusive, by start, then in the order of the rules.

    Per rule the matches are leftmost, longest and do not overlap; those of
    different rules may.  Null text counts as empty; null and repeated ids are
    scanned as they come; a text of any length is read whole, in one pass;
    an empty table gives an empty result."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kinds = [r.kind for r in rules]
        for batch in batches:
            for rows, data, offsets in _texts(batch.column(1)):
                spans: list[list] = [[] for _ in range(len(offsets) - 1)]
                points = None
                for start, r, end in scanner.spans(data, offsets):
                    if points is None:   # code points before every byte
                        lead = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
                        points = np.append(0, np.cumsum(lead))
                    t = int(np.searchsorted(offsets, start, "right")) - 1
                    first = points[offsets[t]]
                    spans[t].append({"kind": kinds[r], "start": int(points[start] - first), "end": int(points[end] - first)})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start, len(spans)),
                                                  pa.array(spans, pa.list_(_SPAN))], names=["id", "spans"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return picked.mapInArrow(run, _FOUND).withColumnRenamed("id", id_col)


def _texts(text: pa.Array) -> Iterator[tuple[slice, bytes, np.ndarray]]:
    """(rows, bytes, offsets) of runs of texts with a bounded size; a longer
    text is a run of its own."""
    n = len(text)
    wide = np.int64 if pa.types.is_large_string(text.type) else np.int32
    off = np.frombuffer(text.buffers()[1], wide)[text.offset:text.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = text.buffers()[2] if n else None
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE_BYTES, "right")) - 1)
        size = int(off[hi] - off[lo])
        yield slice(lo, hi), raw.slice(int(off[lo]), size).to_pybytes() if size else b"", off[lo:hi + 1] - off[lo]
        lo = hi


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    return found.select("doc_id", *[number(r.kind).alias(f"n_{r.kind}") for r in BASE],
                        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql_rule(place: int, rule: Rule) -> str:
    """Matches of one rule with their code points: the pieces between matches
    and the matches alternate."""
    fold = "(?i)" if rule.ignore_case else ""
    head, tail = rule.head.replace("'", "''").replace("(", "(?:"), rule.tail
    if rule.ignore_case:   # only ASCII letters in either case
        fold, head = "", "".join(f"[{c}{c.upper()}]" if c.isalpha() and head[i - 1:i] != "\\" else c
                                 for i, c in enumerate(head))
        head = head.replace(r"\x20", " ")
    pattern = f"{fold}{head}{tail}+"
    return f"""
  SELECT row, doc_id, {place} AS place, '{rule.kind}' AS kind, m, s, s + length(m) AS e FROM (
    SELECT row, doc_id, m, sum(length(gap)) OVER w + sum(length(m)) OVER w - length(m) AS s FROM (
      SELECT row, doc_id, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap FROM (
        SELECT row, doc_id, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS gaps FROM d))
    WINDOW w AS (PARTITION BY row ORDER BY i))
  WHERE length(regexp_replace(m, '^{head}', '')) >= {rule.least}"""


ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents
), f AS ({" UNION ALL ".join(_sql_rule(i, r) for i, r in enumerate(BASE + MORE))}
), a AS (
  SELECT row,
         count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (place < {len(BASE)}) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) AS spans
  FROM f GROUP BY row
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (row)
"""

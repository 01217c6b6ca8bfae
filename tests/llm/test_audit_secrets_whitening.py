"""Source audit, secret scan and whitening against brute force, with nulls,
empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from eventlens.llm import automaton, secrets, source_audit, whitening

DOCS = "doc_id long, text string, lang string, source string, n long, term string, spans string, id string, rank int"


def docs_of(spark, rows):
    """rows: (doc_id, text, lang, source); the other columns clash with names the operators use."""
    return spark.createDataFrame([(*r, 7, "x", "y", "z", 1) for r in rows], DOCS)


def rows_of(seed, n, langs=("en", "de", None), sources=("a", "b", None, "c")):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "ÉTÉ", "été", "x1y", "gam-ma", "l'eau", "…", "ß"] + [f"w{c}" for c in "abcdefgh"]
    return [(i if i % 7 else None, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))),
             rng.choice(langs), rng.choice(sources)) for i in range(n)]


AUDIT = {
    "mixed": rows_of(1, 150) + [(1, None, "en", "a"), (2, "", "xx", "only"), (3, "rare words here", "fr", "b"),
                                (4, "other words", "fr", "c"), (5, "é" * 30000 + " wa " * 20000, "en", "b")],
    "repeated": rows_of(2, 12, ("en",), ("a", "b")) * 4,
    "one_source": rows_of(3, 40, ("en",), ("a",)),
    "empty": [],
}


@pytest.mark.parametrize("case", sorted(AUDIT))
def test_audit_equals_sql(spark, case):
    frame = docs_of(spark, AUDIT[case])
    con = duckdb.connect()
    con.register("documents", pa.table({k: pa.array([r[i] for r in AUDIT[case]], t) for i, (k, t) in enumerate(
        [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())])}))
    want = con.execute(f"SELECT lang, source, part, item, value, rank FROM ({source_audit.ORACLE})").fetchall()
    got = [tuple(r) for r in source_audit.audit(frame).collect()]
    assert sorted(got) == sorted(want)
    assert case == "empty" or case == "one_source" or any(r[2] == "pair" for r in got)


def test_audit_counts_flush_and_slices(monkeypatch):
    """Counts do not depend on where slices end or partial counts are sent on."""
    rows = rows_of(4, 60, ("en", "de"), ("a", "b"))
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (2, 3, 1)],
                                       names=["lang", "source", "text"])

    def counted():
        total = {}
        for out in source_audit._count(iter([batch.slice(0, 7), batch.slice(7)])):
            for r in out.to_pylist():
                key = r["lang"], r["source"], r["term"]
                n, d = total.get(key, (0, 0))
                total[key] = n + r["n"], d + r["docs"]
        return total
    whole = counted()
    monkeypatch.setattr(source_audit, "SLICE_BYTES", 50)
    monkeypatch.setattr(source_audit, "FLUSH_ROWS", 3)
    assert counted() == whole and len(whole) > 20


def test_audit_small_shards(spark, monkeypatch):
    frame = docs_of(spark, AUDIT["mixed"])
    want = sorted(map(tuple, source_audit.audit(frame).collect()))
    monkeypatch.setattr(source_audit, "CELLS", 4)
    monkeypatch.setattr(source_audit, "SHARD_TERMS", 2)
    assert sorted(map(tuple, source_audit.audit(frame).collect())) == want


def test_audit_probability_of_large_counts(spark):
    """Exact beyond 64 bits."""
    cases = [(10**13 + 7, 10**15 + 3, 12345), (0, 10**17, 10**9), (9 * 10**17, 9 * 10**17, 1)]
    frame = spark.createDataFrame(cases, "c long, t long, v long")
    got = [r.p for r in frame.select(source_audit.probability("c", "t", "v").alias("p")).collect()]
    assert got == [1 + 10**9 * (c + 2) // (t + 2 * v) for c, t, v in cases]


RULES = secrets.BASE + secrets.MORE
TOKENS = ["password", "passwd", "secret", "token", "api_key", "apikey", "ApiKey", "TOKEN", '"', "'", " ", "  ", ":", "=", "==",
          "abc", "abcdef", "0123456789abcdef", "AKIA", "AKIAIOSFODNN7", "EXAMPLE", "é", "x", "to", "sec", "\n", ",", ".", "ghp_",
          "xoxb-", "AIza", "sk_live_", "A1b2C3d4E5f6G7h8", "-", "_", "/", "f" * 30, "ſ", "K", "\x00"]


def plain_spans(text):
    out = []
    for place, r in enumerate(RULES):
        flags = re.ASCII | (re.IGNORECASE if r.ignore_case else 0)
        for m in re.finditer(f"{r.head}{r.tail}+", text, flags):
            if m.end() - re.match(r.head, text[m.start():], flags).end() - m.start() >= r.least:
                out.append((m.start(), place, m.end()))
    return [(RULES[p].kind, a, b) for a, p, b in sorted(out)]


def test_secrets_equal_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(TOKENS) for _ in range(rng.randrange(0, 400 if i % 9 == 0 else 50))) for i in range(600)]
    texts += [None, "", "token=" + "a" * 100_000 + " " + "f" * 24, "x" * 300_000 + " AKIA" + "A" * 16, "secret=token : abcdefghi",
              "token=ab password=abcdef", "AKIAKIA" + "B" * 15, "é" * 1000 + "passwd:'hunter22'", "f" * 23, "f" * 24]
    frame = docs_of(spark, [(i if i % 5 else None, t, "en", "s") for i, t in enumerate(texts)] + [(1, "token=abcdef", "en", "s")] * 2)
    got = [[tuple(s) for s in r.spans] for r in secrets.find_secrets(frame).collect()]
    want = [plain_spans(t or "") for t in texts] + [[("assign", 0, 12)]] * 2
    assert sorted(got) == sorted(want)
    assert secrets.find_secrets(docs_of(spark, [])).collect() == []


def test_lanes_and_slices_do_not_matter(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice(TOKENS) for _ in range(60)) + "token=" + "b" * 3000 for _ in range(20)]
    scanner = secrets.Scanner(RULES)

    def spans():
        out = []
        for rows, data, offsets in secrets._texts(pa.array(texts)):
            for a, r, b in scanner.spans(data, offsets):
                t = int(np.searchsorted(offsets, a, "right")) - 1
                out.append((rows.start + t, a - int(offsets[t]), r, b - int(offsets[t])))
        return out
    want = spans()
    for lane, rounds, size in ((16, 1, 100), (64, 2, 5000), (7, 50, 1 << 20)):
        monkeypatch.setattr(automaton.Search, "LANE", lane)
        monkeypatch.setattr(automaton.Search, "ROUNDS", rounds)
        monkeypatch.setattr(secrets, "SLICE_BYTES", size)
        assert spans() == want
    assert len(want) >= 20


def test_automaton_is_minimal_and_refuses_other_rules():
    s = automaton.Search([("ab[0-9]{3,}", False), ("[0-9]{5,}", False)])
    # no two states agree on marks and on all continuations
    again, _ = automaton._minimised(s.table, s.marks)
    assert len(again) == len(s.table)
    for pattern in ("xa(bcd)?", "[^a]+", "a", "xa|axay"):
        with pytest.raises(ValueError):
            automaton.Search([(pattern, False)])


@pytest.mark.parametrize("pattern", ["(ab|a)c?[0-9]{2,}", "x*y+", "(a|b(c|d)*)e+", r"\x41?[B-D.]+"])
def test_matcher_equals_re(pattern):
    rng = random.Random(7)
    m, back = automaton.Matcher(pattern), automaton.Matcher(pattern, backwards=True)
    for _ in range(400):
        text = "".join(rng.choice("abcdexyA.BCD0123") for _ in range(rng.randrange(8)))
        ends = [e for e in range(len(text) + 1) if re.fullmatch(pattern, text[:e])]
        assert m.longest(text.encode()) == max(ends, default=-1)
        starts = [len(text) - b for b in range(len(text) + 1) if re.fullmatch(pattern, text[b:])]
        assert back.longest(text.encode()[::-1]) == max(starts, default=-1)


VECTORS = "vec_id long, embedding array<float>, label int, x string, n long, component int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 7, 7) for i, v in rows], VECTORS)


def check_whitening(got, rows, count=4):
    """Against an eigendecomposition of the covariance."""
    good = [(i, np.floor(np.array(v, np.float32).astype(float) * 256)) for i, v in rows]
    X = np.array([v for _, v in good])
    fit = np.unique(X, axis=0)
    n, S = len(fit), fit.sum(0)
    C = fit - S / n
    values, vectors = np.linalg.eigh(C.T @ C / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    r = min(count, int((values > 1e-9 * max(values[0], 1e-30)).sum()))
    assert len(got) == r * len(rows)
    assert (got.n == n).all() and got.identity_error.max() < 1e-9
    for c in range(r):
        mine = got[got.component == c + 1].sort_values(["vec_id", "deviation"])
        z = (X - S / n) @ vectors[:, c] / np.sqrt(values[c])
        deviation = ((n * X - S) ** 2).sum(1).astype(np.int64)
        order = np.lexsort((deviation, [i for i, _ in good]))
        assert mine.vec_id.tolist() == [good[k][0] for k in order]
        assert mine.deviation.tolist() == deviation[order].tolist()
        assert np.abs(np.abs(mine.whitened.to_numpy()) - np.abs(z[order])).max() < 1e-8
        assert abs(mine.explained.iloc[0] - values[c] / values.sum()) < 1e-9


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.standard_normal(9) * np.arange(1, 10)).tolist()) for i in range(200)]
    rows += [(i, v) for i, v in rows[:30]] + [(300 + i, rows[5][1]) for i in range(50)]   # repeated rows and vectors
    check_whitening(whitening.whiten(vectors_of(spark, rows)).toPandas(), rows)


def test_whitening_low_rank(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(-3, 4, (60, 2)) @ rng.integers(-2, 3, (2, 6))
    rows = [(i, (v / 256).tolist()) for i, v in enumerate(base)]
    got = whitening.whiten(vectors_of(spark, rows)).toPandas()
    assert got.component.max() == 2
    check_whitening(got, rows)


def test_whitening_of_equal_eigenvalues():
    """Invariant subspaces: further starts find the rest."""
    X = np.vstack([np.eye(5) * 3, -np.eye(5) * 3, np.eye(5)[3:] * 7, -np.eye(5)[3:] * 7])

    def product(W, w):
        u = X @ np.column_stack([W, w])
        return u[:, :-1].T @ u[:, -1], u[:, -1] @ u[:, -1], X.T @ u[:, -1]
    sigma, vectors = whitening.bidiagonalise(product, 5, 4)
    assert np.allclose(sigma, np.linalg.svd(X)[1][:4]) and np.allclose(vectors.T @ vectors, np.eye(4))
    assert np.allclose(X.T @ X @ vectors, vectors * sigma**2)


def test_whitening_stops_early_when_converged():
    rng = np.random.default_rng(10)
    X = rng.standard_normal((300, 80)) * 0.9 ** np.arange(80)
    calls = []

    def product(W, w):
        calls.append(1)
        u = X @ np.column_stack([W, w])
        return u[:, :-1].T @ u[:, -1], u[:, -1] @ u[:, -1], X.T @ u[:, -1]
    sigma, vectors = whitening.bidiagonalise(product, 80, 4, limit=10)
    assert len(calls) < 70 and np.allclose(sigma, np.linalg.svd(X)[1][:4], rtol=1e-13)
    assert np.abs(X.T @ X @ vectors - vectors * sigma**2).max() < 1e-10 * sigma[0] ** 2


def test_whitening_drops_only_bad_vectors(spark):
    rng = np.random.default_rng(11)
    good = [(i, rng.standard_normal(3).tolist()) for i in range(30)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 0.0, 0.0]), (104, []),
           (105, [1.0, 2.0])]
    got = whitening.whiten(vectors_of(spark, good + bad)).toPandas()
    check_whitening(got, good)
    check_whitening(whitening.whiten(vectors_of(spark, [(None, v) for _, v in good]), count=2).toPandas().fillna({"vec_id": 0}),
                    [(0, v) for _, v in good], 2)


def test_whitening_without_variance_and_empty(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        out = whitening.whiten(vectors_of(spark, rows))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        assert out.collect() == []


def test_whitening_deviation_of_large_values(spark):
    rows = [(i, [float(v), 0.5]) for i, v in enumerate([0, 1e6, -1e6, 3e30])]
    got = whitening.whiten(vectors_of(spark, rows)).toPandas().set_index("vec_id").deviation
    x = [[min(int(np.floor(np.float64(np.float32(v)) * 256)), 2**63 - 1024), 128] for v in (0, 1e6, -1e6, 3e30)]
    S = [sum(c) for c in zip(*x)]
    want = [sum((4 * c - s) ** 2 for c, s in zip(row, S)) for row in x]
    assert got.isna().groupby(level=0).all().tolist() == [w > 2**63 - 1 for w in want]

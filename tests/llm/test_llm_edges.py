"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra
columns with clashing names; brute force where SQL has no form."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.llm import (chat_format, common, exact_dedup, html_text, language_id, mixing, ngram_join, packing,
                           substring_dedup, toxicity, vector_dedup)
from eventlens.llm.words import slices, window_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, sig long, c long, id string, component_id long"


def docs_of(spark, rows):
    """rows: (doc_id, text[, source]); the other columns clash with names the operators use."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, False, 7, 7, "x", 7) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words_of(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz the of and".split()) + str(rng.randrange(60)) for _ in range(n))


EDGES = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "ONE"), (None, words_of(1, 80)), (6, words_of(1, 80)),
         (6, words_of(1, 80)), (6, words_of(2, 70)), (7, "tail " + words_of(1, 80)), (8, "w " * 30000), (9, "é" * 5000),
         (10, "x" * 50000), (11, words_of(2, 70).upper()), (12, "Straße ÀÉ x y")]


def test_words_and_windows():
    import pyarrow as pa
    got = []
    for w in slices(pa.array([None, "", "a b c\x0bd", " x  y ", "É A"]), lower=True):
        got += [w.joined_all(i) for i in range(len(w.first) - 1)]
        assert got == [w.joined(i) for i in range(len(w.first) - 1)]
    assert got == [b"", b"", "a b c d".encode(), b"x y", "É a".encode()]
    keys = np.array([5, 9, 5, 9, 5, 9, 5], np.uint64)
    h = window_hashes(keys, 3)
    assert len(h) == 5 and h[0] == h[2] == h[4] and h[1] == h[3] != h[0]
    assert len(window_hashes(keys, 8)) == 0


def word_list(text):
    return [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_repeats(rows, w):
    seqs = [(2**63 - 1 if d is None else d, word_list(t)) for d, t in rows]
    low = {}
    for d, s in seqs:
        for i in range(len(s) - w + 1):
            k = tuple(s[i:i + w])
            low[k] = min(low.get(k, d), d)
    out = []
    for d, s in seqs:
        gone = set()
        for i in range(len(s) - w + 1):
            if low[tuple(s[i:i + w])] < d:
                gone.update(range(i, i + w))
        kept = " ".join(x for i, x in enumerate(s) if i not in gone)
        out.append((None if d == 2**63 - 1 else d, len(s), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substring_dedup(spark):
    rng = random.Random(3)
    rows = list(EDGES)
    for i in range(20, 60):  # shared passages of 9 to 40 words at random places
        text = words_of(100 + i, rng.randrange(5, 60)).split()
        for _ in range(2):
            p = words_of(rng.randrange(4), 40).split()
            a = rng.randrange(20)
            text[rng.randrange(len(text)):0] = p[a:a + rng.randrange(9, 21)]
        rows.append((i, " ".join(text)))
    for w in (12, 50):
        got = substring_dedup.remove_repeats(docs_of(spark, rows), window=w)
        got = sorted([tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()], key=repr)
        assert got == brute_repeats([r[:2] for r in rows], w)
    assert substring_dedup.remove_repeats(docs_of(spark, [])).collect() == []


def test_exact_dedup(spark):
    rows = [*EDGES, (20, "Same"), (21, "sAME"), (22, "same "), (21, "same"), (None, "SAME")]
    docs = docs_of(spark, rows)

    lower = lower_ascii
    groups = {}
    for d, t in rows:
        groups.setdefault(lower(t), []).append(d)
    want = sorted([(d, max([x for x in groups[lower(t)] if x is not None], default=None), len(groups[lower(t)]),
                    hashlib.sha256(lower(t).encode()).hexdigest()) for d, t in rows], key=repr)
    for digest, batch in ((exact_dedup.sha256, None), (lambda t: F.substring(exact_dedup.sha256(t), 1, 1), 1)):
        got = exact_dedup.exact_dedup(docs, digest=digest, files_per_batch=batch).collect()
        assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == want
        assert sum(r.kept for r in got) == len(groups)
        assert all(r.doc_id == r.keep_id for r in got if r.kept)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert exact_dedup.exact_dedup(docs_of(spark, [])).collect() == []


def brute_groups(rows, k, num, den):
    ids, sets = [], []
    for d, t in rows:
        w = word_list(lower_ascii(t))
        ids.append(2**63 - 1 if d is None else d)
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    lab = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = lab[i], lab[j]
                lab = [b if x == a else x for x in lab]
    out = []
    for i in range(len(rows)):
        low = min(ids[j] for j in range(len(rows)) if lab[j] == lab[i]) if sets[i] else ids[i]
        out.append(tuple(None if x == 2**63 - 1 else x for x in (ids[i], len(sets[i]), low)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100)])
def test_ngram_join(spark, k, num, den):
    rng = random.Random(k)
    rows = list(EDGES)
    for base in range(4):  # chains and clouds of near copies
        text = words_of(200 + base, 60 + 25 * base).split()
        for i in range(25):
            if i % 3 == 0:
                text = list(text)
                text[rng.randrange(len(text))] = f"z{base}_{i}"
            copy = list(text)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"y{rng.randrange(50)}"
            rows.append((1000 - len(rows), " ".join(copy)))
    docs = docs_of(spark, rows)
    got = ngram_join.jaccard_components(docs, words=k, num=num, den=den)
    want = brute_groups(rows, k, num, den)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == want
    if k == 5:
        left = ngram_join.drop_near_copies(docs)
        assert left.columns == docs.columns
        assert {r.doc_id for r in left.select("doc_id").collect()} >= {w[2] for w in want}
        assert ngram_join.jaccard_components(docs_of(spark, [])).collect() == []


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 300), (-5, 300)] + [(500, 500 + i) for i in range(300)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: -5, 150: -5, 300: -5, -5: -5} | {500 + i: 500 for i in range(300)}
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_packing(spark):
    import public_tokenizers as public
    rows = [*EDGES, (30, "a <|endoftext|> b"), (31, "y" * 30000)]
    got = packing.packed_bpe(docs_of(spark, rows), with_ids=True).collect()
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = sorted([(d, i, t) for d, text in rows for i, t in enumerate([*tok.encode(text or "", add_special_tokens=False).ids, 0])], key=repr)
    assert sorted([(r.doc_id, r.start + i, t) for r in got for i, t in enumerate(r.ids)], key=repr) == want
    assert packing.packed_bpe(docs_of(spark, [])).collect() == []


def test_plan_cuts_is_optimal():
    def cost(at, penalty, cuts, window):
        total, last = 0.0, 0
        price = dict(zip(at, penalty))
        for c in cuts:
            n = c - last
            assert 0 < n <= window
            total += packing.P_WIN + (0 if n & (n - 1) == 0 else window - n) + price.get(c, packing.P_MID)
            last = c
        return total

    rng = random.Random(5)
    for _ in range(60):
        window, length = 16, rng.randrange(1, 70)
        at = sorted({0, length, *rng.sample(range(1, length + 1), rng.randrange(1, min(length, 12) + 1))})
        at = sorted({*at, *range(0, length, window)})
        penalty = [0.0] + [rng.choice([0.0, 2.0]) for _ in at[1:]]
        got = packing.plan_cuts(at, penalty, window, True)
        # reference: the same moves, by plain recursion over all pairs
        best = {0: 0.0}
        for j in range(1, len(at)):
            options = []
            for i in range(j):
                n = at[j] - at[i]
                hops = -(-n // window)
                if hops <= packing.HOPS:
                    options.append(best[at[i]] + (hops - 1) * packing.P_MID + hops * (window + packing.P_WIN) - n)
                if n < window and n & (n - 1) == 0:
                    options.append(best[at[i]] + packing.P_WIN)
            best[at[j]] = min(options) + penalty[j]
        assert abs(cost(at, penalty, got, window) - best[length]) < 1e-9 or cost(at, penalty, got, window) < best[length]


def test_mixing(spark):
    rows = [(i, "t", None if i % 11 == 0 else "abc"[min(2, i % 7 // 2)]) for i in range(400)] + [(None, None, "a"), (5, "u", "b"), (5, "u", "b")]
    docs = docs_of(spark, rows)
    for weigh in (mixing.temperature_parts, lambda c: mixing.fixed_parts(c, {"a": 5, "b": 2}, 1)):
        got = mixing.mix(docs, weigh=weigh, block=3).collect()
        assert len(got) == len(rows)
        assert sorted(r.position for r in got) == sorted({r.position for r in got})
        slots = {}
        for r in got:
            assert r.release <= r.slot < r.deadline
            slots[r.slot] = r.source
        assert sorted(slots) == list(range(len(slots)))
    parts, done = {"a": 5, "b": 2, "c": 1, None: 1}, dict.fromkeys(["a", "b", "c", None], 0)
    blocks = {s: sum(v == s for v in slots.values()) for s in parts}
    for t in range(len(slots)):  # all sources still have blocks: at most one block from the share
        if any(done[s] == blocks[s] for s in parts):
            break
        done[slots[t]] += 1
        assert all(abs(done[s] - (t + 1) * parts[s] / 9) < 1 for s in parts)
    left = mixing.interleave(docs, block=3)
    assert left.columns == docs.columns and left.count() == len(rows)
    assert mixing.mix(docs_of(spark, [])).collect() == []


def test_packing_follows_the_mix(spark):
    import os

    import corpus_pipeline as pipe
    # longer texts later in the mix: the last file is the largest, which Spark reads first
    docs = docs_of(spark, [(i, "t", "abc"[i % 7 % 3]) for i in range(300)])
    order = [r.doc_id for r in mixing.mix(docs).orderBy("position").collect()]
    rows = {d: (d, words_of(d, 5 + 4 * n), "abc"[d % 7 % 3]) for n, d in enumerate(order)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixed = common.stage(mixing.interleave(docs_of(spark, list(rows.values()))), "mixed")
        assert len({os.path.basename(f) for f in mixed.inputFiles()}) > 1
        pieces = pipe.pack_windows(spark, mixed, "").orderBy("sequence_id", "offset").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.sequence_id >> 40 for r in pieces}) > 1
    assert list(dict.fromkeys(r.doc_id for r in pieces)) == order


def test_language_edges(spark):
    rows = [(i, f"the quick brown fox {i} jumps") for i in range(30)] + [(40 + i, f"der schnelle braune Fuchs {i} springt über") for i in range(30)]
    docs = docs_of(spark, rows).withColumn("lang", F.when(F.col("doc_id") < 40, "en").otherwise("de"))
    model = language_id.fit(language_id.training_sample(docs, "doc_id", "text", "lang"))
    got = {r.doc_id: r for r in language_id.identify(docs_of(spark, [*EDGES, (50, "12 34 !?"), (51, "the brown fox"), (52, "über Fuchs")]), model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == got[50].lang_pred == "und"
    assert got[51].lang_pred == "en" and got[52].lang_pred == "de"
    assert language_id.fit(language_id.training_sample(docs_of(spark, [(1, None)]), "doc_id", "text", "lang")) is None
    assert {r.lang_pred for r in language_id.identify(docs_of(spark, EDGES), None).collect()} == {"und"}
    assert language_id.identify(docs_of(spark, []), model).collect() == []


def test_toxicity_edges(spark):
    rng = random.Random(1)
    clean = [words_of(300 + i, 30) for i in range(60)]
    bad = [" ".join(rng.sample(words_of(400 + i, 30).split() + ["blockhead", "nitwitted", "blockhead"], 33)) for i in range(40)]
    docs = docs_of(spark, list(enumerate(clean + bad)))
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(100)] + [(None, 1), (3, None), (999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    tests = [*EDGES, (100, "a bl.ockhead and a nit*witted one"), (101, "ab1 cd2 ef3 the4"), (102, "b l o c k h e a d, nitwitted!")]
    got = {r.doc_id: r for r in toxicity.score(docs_of(spark, tests), model).collect()}
    assert got[100].predicted == got[102].predicted == 1
    assert got[101].predicted == got[1].predicted == got[2].predicted == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    left = toxicity.drop_toxic(docs_of(spark, tests), model)
    assert left.columns == docs.columns and {100, 102} & {r.doc_id for r in left.collect()} == set()
    assert toxicity.fit(docs, labels.filter("toxic = 0")) is None
    assert {r.predicted for r in toxicity.score(docs_of(spark, EDGES), None).collect()} == {0}
    assert toxicity.score(docs_of(spark, []), model).collect() == []


def test_toxicity_of_gapped_terms(spark):
    clean = [words_of(300 + i, 30) + " radio riot patriot" for i in range(60)]
    bad = [words_of(400 + i, 30) + " idiot moron" for i in range(40)]
    docs = docs_of(spark, list(enumerate(clean + bad)))
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i >= 60)) for i in range(100)], "doc_id long, toxic int"))
    rest = words_of(7, 20)
    spelt = [[gap.join(w) for w in ("idiot", "moron")] for gap in (".", "--", "*_*", "x", "qz")] + [["i.d..i-o__t", "m1o22r3o--n"]]
    tests = [(i, f"{rest} {a} {rest}, {b}!") for i, (a, b) in enumerate(spelt)] + [(50, f"{rest} radio riot"), (51, "r.a.d.i.o p--a--t--r--i--o--t"), (52, rest)]
    got = {r.doc_id: r.predicted for r in toxicity.score(docs_of(spark, tests), model).collect()}
    assert got == {i: int(i < 50) for i in got} and len(got) == 9
    assert {r.doc_id for r in toxicity.drop_toxic(docs_of(spark, tests), model).collect()} == {50, 51, 52}
    # insults known only in one gapped spelling are found in the others
    gapped = docs_of(spark, list(enumerate(clean + [t.replace("idiot", "i.d.i.o.t").replace("moron", "m-o-r-o-n") for t in bad])))
    model = toxicity.fit(gapped, spark.createDataFrame([(i, int(i >= 60)) for i in range(100)], "doc_id long, toxic int"))
    assert {r.doc_id: r.predicted for r in toxicity.score(docs_of(spark, tests), model).collect()} == got


def test_vectors(spark):
    rng = np.random.default_rng(0)
    rows, truth = [], []
    for label in (1, 2):
        for c in range(12):
            centre = rng.normal(size=12)
            for _ in range(int(rng.integers(1, 9))):
                rows.append((len(rows) * 3, [float(x) for x in centre + rng.normal(size=12) * rng.choice([0.02, 0.1, 0.25])], label))
    rows += [(1, rows[0][1], 1), (None, rows[0][1], 1), (4, None, 1), (5, [0.0] * 12, 1), (7, [1.0, None] + [0.0] * 10, 1), (8, [float("nan")] * 12, 1),
             (10, [float("inf")] + [1.0] * 11, 1), (11, [], 1), (13, rows[0][1], None), (14, rows[0][1][:6], 1), (16, rows[0][1], 1)]
    ids = [2**63 - 1 if r[0] is None else r[0] for r in rows]
    ok = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1]) for r in rows]
    link = np.zeros((len(rows), len(rows)), bool)
    for i in range(len(rows)):
        for j in range(len(rows)):
            if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                link[i, j] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93
    lab = np.array(ids)
    for _ in range(len(rows)):
        lab = np.array([min([lab[i], *lab[link[i]]]) for i in range(len(rows))])
    want = sorted([(r[0], int(link[i].sum()), None if lab[i] == 2**63 - 1 else int(lab[i]), bool(ids[i] == lab[i])) for i, r in enumerate(rows)], key=repr)
    exact = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("cid", F.lit(1))
    got = vector_dedup.link_vectors(exact)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == want
    assert vector_dedup.link_vectors(exact.limit(0)).collect() == []
    assert vector_dedup.link_vectors(exact.withColumn("label", F.lit(None).cast("int"))).agg(F.sum("n_links")).first()[0] == 0


def test_html(spark):
    page = html_text.page_text
    assert page(None) == page("") == ""
    assert page("just  text &amp; more") == "just text & more"
    assert page("<p>a<p>b<div>c<div>d</div></div>e") == "a\n\nb\n\nc\nd\ne"
    assert page("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>z") == "- a\n- b\n  3. c\n  4. d\n\nz"
    assert page("<table><tr><th>Name<th>Qty<tr><td>kiwi fruit<td>2</table>") == "Name        Qty\nkiwi fruit  2"
    assert page("<style>.n{display:none}</style><b class=n>x</b><i hidden>y</i><s style='display: none'>z</s>ok") == "ok"
    assert page("<span style='visibility:hidden'>a<b style='visibility:visible'>b</b></span><details><summary>s</summary>t</details>") == "b\ns"
    assert page("<pre>a\n  b</pre>c<br>d<script>var x='<p>no'</script>") == "a\n  b\n\nc\nd"
    assert page("<div>" * 5000 + "deep") == "deep"
    assert page("a</td></b><unknown>c") == "ac"
    rows = [(1, None), (2, ""), (None, "<p>x"), (2, "<p>" + "word " * 50000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, html string, text string")
    got = sorted([tuple(r) for r in html_text.extract(df).collect()], key=repr)
    assert got == sorted([(1, ""), (2, ""), (None, "x"), (2, ("word " * 50000).strip())], key=repr)
    assert html_text.extract(df.limit(0)).collect() == []


def test_chat(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "PIECE", 3)
    def conv(i, n, first="hi"):
        return [(i, t, "user" if t % 2 == 0 else "assistant", first if t == 0 else f"m{t}") for t in range(n)]
    rows = conv(1, 2) + conv(2, 5) + conv(3, 5) + conv(4, 4) + conv(5, 3, "yo") + conv(5, 3, "yo")
    rows += [(6, 0, None, "hi"), (7, 0, None, None), (8, None, "user", "hi"), (None, 0, "user", "solo"), (9, 0, "user", "hi"), (9, 0, "user", "also")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, seq long")
    got = [tuple(r) for r in chat_format.collapse_and_render(df).collect()]
    by = {}
    for c, seg, n, text in sorted(got, key=lambda r: (repr(r[0]), r[1])):
        by[c] = (n, by.get(c, (0, ""))[1] + text)
    line = "<|{}|>\n{}\n".format
    assert set(by) == {2, 5, 6, 7, None, 9}  # 1, 4 and 8 are prefixes, 3 equals 2
    assert by[2] == (5, "".join(line("user" if t % 2 == 0 else "assistant", "hi" if t == 0 else f"m{t}") for t in range(5)))
    assert by[7] == (1, line("", "")) and by[9] == (2, line("user", "also") + line("user", "hi"))
    assert chat_format.collapse_and_render(df.limit(0)).collect() == []

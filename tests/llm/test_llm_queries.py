"""Queries of the text operators against DuckDB and against brute force on the
smallest tables."""

import os
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from eventlens.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
TABLES = "documents embeddings pages labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = queries.QUERIES[name](spark, SF)
    cols = sorted(found.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE[name]})").fetchall()
    got = [tuple(r) for r in found.select(*cols).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_packing_round_trip(spark):
    import public_tokenizers as public
    from tokenizers import Tokenizer
    from eventlens.llm.packing import packed_bpe
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = packed_bpe(docs, with_ids=True).toPandas()
    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rows = docs.toPandas()
    want = {d: [*e.ids, 0] for d, e in zip(rows.doc_id, tok.encode_batch(list(rows.text), add_special_tokens=False))}
    back = defaultdict(list)
    for p in pieces.sort_values(["doc_id", "start"]).itertuples():
        assert p.start == len(back[p.doc_id]) and p.length == len(p.ids) and p.doc_tokens == len(want[p.doc_id])
        assert zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32
        back[p.doc_id] += list(p.ids)
    assert back == want
    size = pieces.groupby("sequence_id").length.sum()
    assert size.max() <= 1024
    pad = sum(0 if n & (n - 1) == 0 else 1024 - n for n in size)
    assert pad < 0.02 * size.sum()
    pieces = pieces.sort_values(["sequence_id", "offset"])
    after = (pieces.offset + pieces.length).groupby(pieces.sequence_id).shift().fillna(0)
    assert (after == pieces.offset).all()


def test_language_held_out(spark):
    found = queries.QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    held = found[found.held_out].merge(docs, on="doc_id")
    assert len(found) == len(docs) and len(held) > 100
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert found.score.between(0, 1).all()


def test_toxicity_held_out(spark):
    found = queries.QUERIES["op2_toxicity"](spark, "/root/testdata/sf0.1").toPandas()
    labels = pd.read_parquet("/root/testdata/sf0.1/labels.parquet")
    held = found[found.held_out].merge(labels, on="doc_id")
    assert ((held.predicted == 1) & (held.toxic == 0)).sum() <= 0.002 * len(held)
    assert held[held.toxic == 1].predicted.mean() > 0.7
    assert found.score.between(0, 1).all() and ((found.score >= 0.7) == (found.predicted == 1)).all()


def test_pipeline_effects(spark):
    import corpus_pipeline as pipe
    from eventlens.llm import exact_dedup, ngram_join, toxicity
    from eventlens.llm.common import stage
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {}
    for name, step in pipe.STAGES[:4]:
        before = docs
        docs = stage(step(spark, docs, SF), name)
        assert docs.columns == before.columns
        kept[name] = (before, docs)
    ids = {n: ({r.doc_id for r in a.select("doc_id").collect()}, {r.doc_id for r in b.select("doc_id").collect()}) for n, (a, b) in kept.items()}
    a, b = ids["toxicity"]
    scores = toxicity.score(kept["toxicity"][0], toxicity.fit(kept["toxicity"][0], labels)).toPandas()
    assert a - b == set(scores[scores.predicted == 1].doc_id)
    a, b = ids["exact_dedup"]
    rows = exact_dedup.exact_dedup(kept["exact_dedup"][0]).toPandas()
    assert b == set(rows[rows.kept].doc_id)
    a, b = ids["ngram_jaccard"]
    rows = ngram_join.jaccard_components(kept["ngram_jaccard"][0]).toPandas()
    assert b == set(rows.component_id) and len(b) < len(a)
    a, b = ids["mixing"]
    assert a == b
    pieces = pipe.pack_windows(spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == b

"""Queries of the training-data operators on the given tables, against SQL and brute force."""

import os
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ketspark.llm import decontaminate, quality, queries, tokens

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    expected = sorted(map(repr, cur.fetchall()))
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert sorted(repr(tuple(r)) for r in got.select(*names).collect()) == expected


def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def test_leaks_by_brute_force(spark):
    """Every passage against every item, without index, blocks or bounds."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id", "text").collect()]
    index, expected = decontaminate.Index(items), {}
    matcher = decontaminate.Matcher(index)
    for doc_id, text in texts(spark).items():
        words = matcher.number((text or "").encode().split()).tolist()
        step = index.longest
        for p in range(len(words) // step + 1):
            own = words[p * step : (p + 2) * step]
            scores = defaultdict(float)
            for t in set(own) - {len(index.terms)}:
                for item, w in index.postings[t]:
                    scores[item] += w
            held = decontaminate.shingles(own)
            for item, score in scores.items():
                q, a = (decontaminate.overlap(part[item], own, held) for part in (index.questions, index.answers))
                if score >= decontaminate.THRESHOLD and q >= decontaminate.OVERLAP and a >= decontaminate.OVERLAP:
                    expected[doc_id, index.ids[item]] = max(expected.get((doc_id, index.ids[item]), (0, 0, 0)), (score, q, a))
    got = {(r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap) for r in queries.QUERIES["op9_benchmark_decontamination"](spark, DATA).collect()}
    assert expected and got.keys() == expected.keys()
    assert all(np.allclose(got[k], v) for k, v in expected.items())


def test_tokens_and_pieces_by_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    ids = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in texts(spark).items()}
    crc = lambda part: zlib.crc32(np.array(part, "<u4").tobytes())
    start, expected = 0, []
    for i in sorted(ids):
        own = [*ids[i], 2]
        expected.append((i, start, len(own), crc(own)))
        start += len(own)
    assert sorted(tuple(r) for r in queries.QUERIES["op7_token_files"](spark, DATA).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == expected
    pieces = sorted((i, k // 2048, k, len(part), crc(part)) for i, x in ids.items() for own in [[*x, 0]] for k in range(0, len(own), 2048) for part in [own[k : k + 2048]])
    packed = queries.QUERIES["op2_best_fit_packing"](spark, DATA).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == pieces
    filled = defaultdict(int)
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048 and len(filled) <= -(-sum(p[3] for p in pieces) // 2048) * 1.25


def test_base_rules_hold_in_the_query(spark):
    rows = queries.QUERIES["op5_quality_rules"](spark, DATA)
    assert rows.count() == len(texts(spark))
    wrong = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    assert not rows.where(wrong != F.col("base_failed")).count() and not rows.where("base_failed and kept").count()
    far = F.coalesce(F.col("distance"), F.lit(0.0)) > quality.CUTOFF
    assert not rows.where(~F.col("base_failed") & (far == F.col("kept"))).count()


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one question here. an answer")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

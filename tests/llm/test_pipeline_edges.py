"""The pipeline on nulls, repeated rows, clashing columns and an empty table."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
from lemmaweave.llm.common import stored

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, block string, slot int, epoch string"


def run(spark, rows: list) -> list:
    docs = spark.createDataFrame(rows, SCHEMA)
    columns = docs.columns
    docs = stored(docs, "edges")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, "/root/testdata/sf0.001"), f"edges-{name}")
        assert set(columns) <= set(docs.columns)
    return docs.collect()


def test_pipeline_edges(spark):
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(120))
    a, b, c, d, e = (text() for _ in range(5))
    tail = ("en", None, 1, "clash", 7, "clash")
    rows = [(1, a, *tail), (2, a, *tail), (3, b, *tail), (3, c, *tail), (3, c, *tail), (None, d, *tail), (None, d, *tail), (4, None, *tail), (5, "", *tail), (6, "few words", *tail), (7, e, "de", "s", 1, None, None, None)]
    got = run(spark, rows)
    # copies go, also among rows without an id, but not the second text of a repeated id
    assert {(r.doc_id, r.text) for r in got} == {(1, a), (3, b), (3, c), (None, d), (7, e)}
    count = Counter((r.doc_id, r.text) for r in got)
    assert count[None, d] <= 2 and {r.block for r in got if r.doc_id != 7} == {"clash"}
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert run(spark, []) == []

"""The corpus pipeline against brute force on its small input, stage by stage."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from lemmaweave.llm.common import stored

SF = "/root/testdata/sf0.001"


def words(t: str | None) -> list[str]:
    return [w.decode() for w in (t or "").encode().split()]


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mix_sources", "shard"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        seen.append(docs.collect())
        assert name == "shard" or docs.columns == columns
    raw, kept, distinct, clean, mixed, placed = seen
    for r in raw:  # base rules, by hand
        w = words(r.text)
        if len(w) < 50:
            assert r not in kept
    # near-duplicates: no two left are alike, and each that went has a partner that stayed
    sets = {r.doc_id: {tuple(words(r.text)[i : i + 5]) for i in range(len(words(r.text)) - 4)} for r in kept}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    ids = {r.doc_id for r in distinct}
    assert not any(alike(a, b) for a in ids for b in ids if a < b)
    assert all(any(alike(a, b) for b in sets if b < a) for a in set(sets) - ids)
    items = [" ".join(words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {r.doc_id for r in distinct if any(t in " ".join(words(r.text)) for t in items)}
    assert {r.doc_id for r in distinct} - {r.doc_id for r in clean} == leaks
    count = Counter(r.doc_id for r in mixed)
    assert set(count) == {r.doc_id for r in clean} and max(count.values()) <= 3
    assert Counter(r.doc_id for r in placed) == count

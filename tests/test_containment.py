"""Containment against brute force."""

from __future__ import annotations

import random

from lemmaweave.operators import relational


def test_containment_by_pieces_and_fronts(spark):
    rng = random.Random(3)
    words = ["a", "bc", "def", "", "naïve", "\n", "x" * 30, "a\tb"]
    said = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 14))) for _ in range(60)]
    asked = {t[i:j] for t in said for i, j in [sorted((rng.randrange(len(t) + 1), rng.randrange(len(t) + 1)))] if rng.random() < 0.6} | {"", " ", "  ", "c d", "zz", "bc a def"}
    texts = [(i, t) for i, t in enumerate(said)] + [(0, said[0]), (None, said[1]), (99, None)]
    needles = [(f"n{i}", n) for i, n in enumerate(sorted(asked))] + [("n0", ""), (None, "bc"), ("none", None)]
    want = sorted(((d, n) for d, t in texts for n, x in needles if t is not None and x is not None and x in t), key=str)
    rows, items = spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(needles, "item_id string, needle string")
    got = relational.containment(rows, items).select("doc_id", "item_id").collect()
    assert sorted(map(tuple, got), key=str) == want and len(want) > 500
    assert relational.containment(rows, items.where("false")).count() == 0 == relational.containment(rows.where("false"), items).count()

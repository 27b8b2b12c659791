"""A phrase in very many different texts: right results, and no join by windows."""

from __future__ import annotations

import random

import pytest

from lemmaweave.llm import passages, phrase_automata


def text(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n)]


@pytest.fixture(scope="module")
def table() -> list[tuple[int | None, str]]:
    rng = random.Random(11)
    phrase, passage = text(rng, 8), text(rng, 120)
    rows = [(i, text(rng, 45) + phrase + text(rng, 45)) for i in range(40)]
    for i in range(40):  # near copies: some of their windows are the same, no segment need be
        words = list(passage)
        for _ in range(3):
            words[rng.randrange(120)] = f"x{rng.randrange(1000)}"
        rows.append((100 + i, words))
    own = text(rng, 60)
    rows += [(300, [w for i in range(6) for w in (*own, f"y{i}", *text(rng, 20))]), (301, own), (None, passage), (None, own)]
    return [(i, " ".join(w)) for i, w in rows]


def removed(rows: list[tuple[int | None, str]]) -> list[tuple]:
    order = lambda i: passages.LAST if i is None else i
    first: dict[tuple, int] = {}
    for i, t in rows:
        w = t.split()
        for p in range(len(w) - 49):
            first[tuple(w[p : p + 50])] = min(first.get(tuple(w[p : p + 50]), order(i)), order(i))
    out = []
    for i, t in rows:
        w = t.split()
        gone = {q for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < order(i) for q in range(p, p + 50)}
        out.append((order(i), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("hot", [1, 7])
def test_windows_of_a_hot_phrase_meet_no_join(spark, table, hot, monkeypatch):
    joined = []
    spread_join = passages.spread_join
    monkeypatch.setattr(passages, "spread_join", lambda rows, side, keys, *rest, **more: joined.append(keys) or spread_join(rows, side, keys, *rest, **more))
    monkeypatch.setattr(phrase_automata.items, "__defaults__", (hot,))
    monkeypatch.setattr(phrase_automata, "SETTLED", 5, raising=False)
    docs = spark.createDataFrame(table, "doc_id bigint, text string").repartition(5)
    got = [(passages.LAST if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_text if r.n_removed else None) for r in phrase_automata.cleaned(docs).collect()]
    want = [(i, n, gone, kept if gone else None) for i, n, gone, kept in removed(table)]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(x[2] > 0 for x in want) > 20
    assert joined and ["wh1", "wh2"] not in joined

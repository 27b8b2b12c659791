"""The corpus operators against brute force on small fixtures with nulls, ties, long, empty and repeated rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lemmaweave.llm import chat_prefix, decontam, hashing, license_scan, mixing, passages, phrase_automata, probminhash, quality_ledger, queries, resharding, suffix_dedup, url_reputation
from lemmaweave.llm.common import spread_join

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words int, size string"


def sentences(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(7)
    passage = sentences(rng, 90)
    base = sentences(rng, 300)
    out: list[tuple[int | None, str | None]] = [(i, sentences(rng, rng.randint(1, 400))) for i in range(30)]
    out += [(30 + i, f"{sentences(rng, 40)} {passage} {sentences(rng, 30)}") for i in range(8)]
    for i in range(8):  # near copies
        w = base.split()
        for _ in range(i):
            w[rng.randrange(len(w))] = "zz"
        out.append((40 + i, " ".join(w)))
    out += [(60, base), (61, base), (62, ""), (63, None), (64, " \n\t "), (65, "é" * 300 + " ü" * 200), (66, "spam " * 400), (67, passage), (68, f"{passage}\n\n{passage}")]
    out += [(2, out[2][1]), (3, "another text under the same number"), (None, passage), (None, base), (70, sentences(rng, 6000))]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if (i or 0) % 2 else None, ["a", "b", None][(i or 0) % 3], len(t or ""), -1, "clash") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t: str | None) -> list[str]:
    return [w.decode() for w in (t or "").encode().split()]


def order(i: int | None) -> int:
    return passages.LAST if i is None else i


@pytest.mark.parametrize("hot", [0, 4096])
def test_phrase_automata(docs, texts, hot, monkeypatch):
    monkeypatch.setattr(phrase_automata.items, "__defaults__", (hot,))
    first: dict = {}
    for i, t in sorted(texts, key=lambda x: order(x[0])):
        w = words(t)
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), order(i))
    want = Counter()
    for i, t in texts:
        w, gone = words(t), set()
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < order(i):
                gone |= set(range(p, p + 50))
        want[i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in phrase_automata.cleaned(docs).collect())
    assert got == want and sum(k[2] for k in want) > 500


def test_suffix_dedup(docs, texts):
    def check() -> None:
        got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.cleaned(docs).collect())
        assert got == want and sum(k[2] for k in want) > 3000

    first: dict = {}
    for i, t in texts:
        b = (t or "").encode()
        for p in range(len(b) - 99):
            key = (order(i), p)
            first[b[p : p + 100]] = min(first.get(b[p : p + 100], key), key)
    want = Counter()
    for i, t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if first[b[p : p + 100]] < (order(i), p):
                gone[p : p + 100] = b"\1" * 100
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        want[i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()] += 1
    check()


def test_loser_tree_merges_and_keeps_prefixes():
    rng = random.Random(3)
    rows = sorted({(bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))), 0, i, 0) for i in range(300)})
    runs = [suffix_dedup.front_coded(sorted(rows[k::7])) for k in range(7)]
    out, last = [], b""
    for shared, item, left, did, lo in suffix_dedup.merged(runs):
        assert shared == suffix_dedup.shared_prefix(last, item, 0)
        out.append((item, left, did, lo))
        last = item
    assert out == rows
    shard = np.array([rng.randrange(3) for _ in range(len(runs[0].tails))])
    for number, part in suffix_dedup.sliced(runs[0], shard):
        assert list(part.suffixes()) == [x for x, s in zip(runs[0].suffixes(), shard, strict=True) if s == number]


def test_hot_fronts_are_dealt_over_shards(docs, spark):
    """All suffixes in shards that several splitters share give the same result through the aggregation."""
    unit = suffix_dedup.Bytes()
    found = suffix_dedup.sorted_runs(passages.involved(docs, passages.first_texts(docs), unit), unit).cache()
    places = found.where("kind = 'o'").select("did", "tk", "los", "ih1", "ih2")
    early = lambda fd, fp, did, lo: (fd < did) | ((fd == did) & (fp < lo))

    def removed(cuts) -> dict:
        items = suffix_dedup.merged_items(suffix_dedup.exchanged(found, np.array(cuts, np.int64)), unit, 5)
        return {(r.did, r.tk): passages.covered([(x.a, x.b) for x in r.ranges], 100) for r in passages.resolved(items, places, early).collect()}

    fronts = [r.front for r in found.where("kind = 'o'").select("front").distinct().collect()]
    assert removed([]) == removed(sorted([f for f in fronts for _ in range(3)]))


def test_automaton_locates_whole_words():
    got = phrase_automata.located(["a b a b a".split(), "ab a b".split()], ["a b", "b a"], most=1)
    assert sorted(zip(*(x.tolist() for x in got), strict=True)) == [(0, 0, 0), (0, 1, 1), (0, 2, 0), (0, 3, 1), (1, 1, 0)]


def test_hot_keys_are_dealt_over_tasks(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 500).alias("k"))
    side = rows.groupBy("k").agg(F.max("id").alias("top"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        for how in ("left", "inner"):
            out = spread_join(rows, side, ["k"], ["id"], how)
            per_task = out.select("id", "k", "top", F.spark_partition_id().alias("task")).collect()
            most = Counter(r.task for r in per_task).most_common(1)[0][1]
            assert most < 1000  # one task would have the 2000 rows of the hot key
            assert sorted((r.id, r.top) for r in per_task) == sorted((r.id, r.top) for r in rows.join(side, "k").collect())
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_anchors_agree_between_equal_windows():
    rng = np.random.default_rng(1)
    part = rng.integers(97, 101, 400).astype(np.uint8)
    a, b = (np.concatenate([rng.integers(97, 101, n).astype(np.uint8), part, rng.integers(97, 101, 50).astype(np.uint8)]) for n in (30, 77))
    picks = []
    for x in (a, b):
        seen = {}
        for _, q, lo, hi, _ in zip(*hashing.anchors(x, np.array([0, len(x)]), 100, 40), strict=True):
            seen |= {bytes(x[p : p + 100]): q - p for p in range(lo, hi + 1)}
        assert len(seen) == len(x) - 99
        picks.append(seen)
    assert all(picks[0][w] == picks[1][w] for w in set(picks[0]) & set(picks[1]))


def components(n: int, links: list[tuple[int, int]]) -> list[int]:
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_near_duplicates(docs, texts):
    sets = []
    for _, t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = []
    for a in range(len(texts)):
        for b in range(a):
            if texts[a][0] is None or texts[b][0] is None:
                continue
            near = len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and sets[a]
            if near or (texts[a][1] or "") == (texts[b][1] or "") or texts[a][0] == texts[b][0]:
                links.append((a, b))
    root = components(len(texts), links)
    small: dict[int, int] = {}
    for i, (d, _) in enumerate(texts):
        if d is not None:
            small[root[i]] = min(small.get(root[i], d), d)
    got = {(r.doc_id, r.class_id) for r in probminhash.classes(docs).collect()}
    assert got == {(d, None if d is None else small[root[i]]) for i, (d, _) in enumerate(texts)}
    # what stays: the first text of each group of copies; that a doc_id repeats makes no copy
    root = components(len(texts), [(a, b) for a, b in links if texts[a][0] != texts[b][0] or (texts[a][1] or "") == (texts[b][1] or "")])
    best: dict[int, tuple] = {}
    for i, (d, t) in enumerate(texts):
        if d is not None:
            key = (d, hashlib.md5((t or "").encode()).hexdigest())
            best[root[i]] = min(best.get(root[i], key), key)
    kept = sorted((r.doc_id, hashlib.md5((r.text or "").encode()).hexdigest()) for r in probminhash.deduplicated(docs).where("doc_id is not null").collect())
    assert kept == sorted(best.values())


def test_near_duplicates_of_every_text_of_a_repeated_id(spark):
    """All texts under a repeated doc_id keep their links, in any row order."""
    rng = random.Random(21)

    def near(t: str) -> str:
        w = t.split()
        w[rng.randrange(len(w))] = "zz"
        return " ".join(w)

    a, b, c = (sentences(rng, 200) for _ in range(3))
    rows = [(2, a), (2, b), (5, near(b)), (6, near(a)), (11, c), (15, c), (15, near(a)), (19, near(c)), (30, sentences(rng, 200))]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
        assert {(r.doc_id, r.class_id) for r in probminhash.classes(docs).collect()} == {(2, 2), (5, 2), (6, 2), (11, 2), (15, 2), (19, 2), (30, 30)}


def test_near_duplicates_at_lower_similarity(spark):
    """A text inside a longer one has the ratio of their sizes."""
    rng = random.Random(22)
    w = sentences(rng, 304).split()
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w[:199])), (3, " ".join(w[:150]))], "doc_id bigint, text string")
    low = probminhash.NearDup(rows=2, similarity=0.6)
    assert {r.doc_id: r.class_id for r in probminhash.classes(docs, low).collect()} == {1: 1, 2: 1, 3: 1}
    assert probminhash._jaccard(np.arange(130, dtype=np.uint64).tobytes(), np.arange(200, dtype=np.uint64).tobytes(), 0.6) == 0.65


def test_long_texts_go_by_blocks(monkeypatch):
    """A text longer than a block has the hashes it has in one piece."""
    rng = np.random.default_rng(3)
    data = rng.choice(np.frombuffer(b"abc  \n", np.uint8), 5000)
    offsets = np.array([0, 1200, 5000])
    whole = hashing.word_hashes(data, offsets)
    sets = probminhash.shingles(whole[0], whole[3], 5)
    monkeypatch.setattr(hashing, "BLOCK", 64)
    parts = hashing.word_hashes(data, offsets)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    assert all((a == b).all() for a, b in zip(sets, probminhash.shingles(parts[0], parts[3], 5), strict=True))


def test_block_links_find_every_class_pair():
    rng = np.random.default_rng(0)
    base = np.sort(rng.integers(0, 2**62, 100).astype(np.uint64))
    near, far = base.copy(), np.sort(rng.integers(0, 2**62, 100).astype(np.uint64))
    near[:5] = near[:5] + np.uint64(1)
    block = lambda *x: ([i for i, _ in x], [i for i, _ in x], [s.tobytes() for _, s in x])
    assert probminhash._block_links(block((1, base)), block((1, base), (2, near), (3, far)), 0.8) == [(1, 2)]


def test_sketch_estimates_probability_jaccard():
    rng = np.random.default_rng(5)
    h = hashing.mix(np.arange(600, dtype=np.uint64) + np.uint64(99))
    w = rng.integers(1, 4, 600)
    text = np.concatenate((np.zeros(500, np.int64), np.ones(500, np.int64)))
    regs = probminhash.sketch(text, np.concatenate((h[:500], h[100:])), np.concatenate((w[:500], w[100:])), 2, 4096)
    wa, wb = np.where(np.arange(600) < 500, w, 0), np.where(np.arange(600) >= 100, w, 0)
    pa, pb = wa / wa.sum(), wb / wb.sum()
    both = (wa > 0) & (wb > 0)
    want = sum(1 / np.maximum(pa / pa[d], pb / pb[d]).sum() for d in np.flatnonzero(both))
    assert abs(probminhash.estimate(regs[0], regs[1]) - want) < 0.04


def test_quality_ledger(docs, texts):
    want = Counter()
    for i, t in texts:
        t = t or ""
        w = words(t)
        grams = Counter(tuple(w[p : p + 3]) for p in range(len(w) - 2))
        hit = {p + k for p in range(len(w) - 2) if grams[tuple(w[p : p + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        base = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), base] += 1
    rows = quality_ledger.with_policy(quality_ledger.ledger(docs), "base").collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, not r.kept) for r in rows) == want
    alone = {(r.policy, r.rule): r for r in quality_ledger.ablation(quality_ledger.ledger(docs)).collect()}
    short = [r for r in rows if r.failed & 1]
    assert alone["base", "few_words"].n_failed == len(short)
    assert alone["base", "few_words"].n_failed_alone == sum(1 for r in short if r.failed & 3 == 1)


def test_urls(spark):
    urls = ["https://A.Example.COM/en/x?q", "https://www.example.com/en/", "https://example.com", "http://x.net/es/", "net/es/", None, "ftp://n.net/fr/1#a", "https://good.org/1", "https://bad.org/9", ""]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    outcomes = spark.createDataFrame([("bad.org", 1)] * 60 + [("good.org", 0)] * 60 + [(None, 1), ("x.org", None)], "host string, bad int")
    got = {r.page_id: r for r in url_reputation.url_verdicts(pages, outcomes).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(7)] == [
        ("a.example.com", "/en/x", "example.com/en/"), ("www.example.com", "/en/", "www.example.com/en/"), ("example.com", "", None),
        ("x.net", "/es/", "net/es/"), ("", "", None), ("", "", None), ("n.net", "/fr/1", "net/fr/")]
    assert [got[i].verdict for i in (0, 1, 3, 7, 8)] == ["block", "allow", "block", "allow", "block"]
    assert url_reputation.url_verdicts(pages.limit(0), outcomes.limit(0)).count() == 0


def test_reputation_is_shrunk_at_every_level(spark):
    """Hosts without labels follow their domain, then their suffix; a few good pages do not free a host of a bad domain."""
    outcomes = [("a.bad.com", 1)] * 50 + [("b.bad.com", 1)] * 45 + [("a.good.com", 0)] * 200 + [("b.good.com", 0)] * 150 + [("x.one.evil", 1)] * 40 + [("y.two.evil", 1)] * 40 + [("c.good.com", 1)] + [("n.fine.org", 0)] * 100 + [("o.fair.org", 0)] * 90
    frame = spark.createDataFrame(outcomes + [(None, 1), ("x.org", None)] + [("c.bad.com", 0)], "host string, bad int")
    hosts = ["a.bad.com", "c.bad.com", "new.bad.com", "a.good.com", "c.good.com", "new.good.com", "new.new.evil", "new.new.org", "new.new.com", "n.unknown"]
    pages = spark.createDataFrame([(i, f"https://{h}/x", "clash", 1) for i, h in enumerate(hosts)] * 2, "page_id bigint, url string, bad string, worse int")
    rows = url_reputation.url_verdicts(pages, frame, rules=()).collect()
    assert len(rows) == 2 * len(hosts)
    got = {r.host: r.verdict for r in rows}
    assert {h for h, v in got.items() if v == "block"} == {"a.bad.com", "c.bad.com", "new.bad.com", "new.new.evil"}


def test_posterior_probability(spark):
    """Against a fine sum over the density itself."""
    cases = [(0.1, 10.0, 0.1), (0.02, 2.0, 0.1), (0.5, 1000.0, 0.52), (0.9, 30.0, 0.5), (0.3, 5e6, 0.3005)]
    frame = spark.createDataFrame(cases, "m double, w double, r double")
    got = [x[0] for x in frame.select(url_reputation.worse_than(F.col("m"), F.col("w"), F.col("r"))).collect()]
    for (m, w, r), p in zip(cases, got, strict=True):
        a, b = m * w, (1 - m) * w
        u = np.linspace(np.log(a / b) - 40 * np.sqrt(1 / a + 1 / b) - 40 / a, np.log(a / b) + 40 * np.sqrt(1 / a + 1 / b) + 40 / b, 2_000_001)
        f = a * u - (a + b) * np.logaddexp(0, u)
        f = np.exp(f - f.max())
        assert abs(f[u > np.log(r / (1 - r))].sum() / f.sum() - p) < 2e-3


def test_chat_prefix(spark):
    rows = [(1, 0, "user", "a\\<|turn|>b"), (1, 1, "assistant", "</s>[INST] é\n"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "user", "tail <|close|>"),
            (2, 0, None, "x"), (2, 0, None, "x"), (None, 0, "assistant", "only"), (3, None, "assistant", "\\")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, example string")
    each = chat_prefix.examples(frame).withColumn("turns", chat_prefix.parsed_turns(F.col("text"))).withColumn("loss", chat_prefix.loss_text(F.col("text"), F.col("loss_start"), F.col("loss_length"))).collect()
    by = {(r.conv_id, r.example): r for r in each}
    assert len(by) == 6
    assert [(t.role, t.text) for t in by[1, 2].turns] == [(r[2] or "", r[3] or "") for r in rows[:5]]
    assert [t.text for t in by[1, 0].turns] == [rows[0][3], rows[1][3]] and by[1, 0].loss == rows[1][3] and by[1, 1].loss == ""
    assert by[1, 2].loss_start is None and len(by[2, 0].turns) == 2 and by[None, 0].loss == "only" and by[3, 0].loss == "\\"


def test_mixing_weights_and_order(spark):
    rng = random.Random(1)
    rows = [(i, sentences(rng, rng.randint(5, 30)), None, "big" if i % 10 else ["s1", "s2", None][i // 10 % 3], 0, 0, "") for i in range(900)] + [(5000, None, None, "void", 0, 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    mix = mixing.Mix(entropy=0.9, repeats=3.0, block_docs=32)
    out = mixing.mixed(docs, mix, keep=("lang",)).collect()
    seen = Counter(r.doc_id for r in out)
    assert set(seen) == {r[0] for r in rows} and max(seen.values()) <= 3 + 1
    assert len({(r.source, r.epoch, r.block_rank, r.slot) for r in out}) == len(out)
    tokens = Counter()
    for r in out:
        tokens[r.source or ""] += r.n_tokens
    total = sum(tokens.values())
    own = Counter()
    for r in rows:
        own[r[3] or ""] += len(words(r[1]))
    a = mixing.exponent(mixing.source_totals(mixing.with_tokens(docs)).where("tokens > 0"), mix)
    power = {k: (v / sum(own.values())) ** a for k, v in own.items() if v}
    for k, p in power.items():
        assert abs(tokens[k] / total - p / sum(power.values())) < 0.02
    assert mixing.mixed(docs.limit(0), mix).count() == 0


def test_min_cost_flow_is_optimal():
    rng = random.Random(2)
    for _ in range(20):
        supply = [rng.randint(0, 9) for _ in range(3)]
        capacity = [rng.randint(0, 9) for _ in range(3)]
        capacity[0] += max(0, sum(supply) - sum(capacity))
        cost = [[rng.randint(0, 4) for _ in range(3)] for _ in range(3)]
        flow = resharding.min_cost_flow(supply, capacity, lambda i, j: cost[i][j])
        assert all(sum(v for (a, _), v in flow.items() if a == i) == s for i, s in enumerate(supply))
        assert all(sum(v for (_, b), v in flow.items() if b == j) <= c for j, c in enumerate(capacity))
        best: dict = {tuple(capacity): 0}
        for i, s in enumerate(supply):
            for _ in range(s):
                new: dict = {}
                for left, spent in best.items():
                    for j in range(3):
                        if left[j]:
                            k = (*left[:j], left[j] - 1, *left[j + 1 :])
                            new[k] = min(new.get(k, 1 << 30), spent + cost[i][j])
                best = new
        assert sum(cost[i][j] * v for (i, j), v in flow.items()) == min(best.values())


def test_resharding(spark):
    rng = random.Random(4)
    copies = sentences(rng, 60)
    rows = [(i, sentences(rng, rng.randint(1, 80))) for i in range(1500)] + [(2000 + i, copies) for i in range(900)] + [(9000, None), (9001, ""), (9002, "é"), (9002, "é")]
    docs = spark.createDataFrame([(*r, None, None, 0, 0, "") for r in rows], SCHEMA)
    out = resharding.resharded(docs).collect()
    assert len(out) == len(rows)
    by_id = dict(rows)
    size = Counter()
    for r in out:
        raw = (by_id[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw)) and 0 <= r.shard < 40
        size[r.shard] += r.size
    assert len(size) == 40 and max(size.values()) < 1.05 * sum(size.values()) / 40
    for s in size:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(1 for r in out if r.shard == s)))
    homes: dict = {}
    for r in out:
        homes.setdefault(by_id[r.doc_id] or "", set()).add(r.shard)
    assert sum(len(h) > 1 for t, h in homes.items()) == 1  # only the group that exceeds a shard
    assert resharding.resharded(docs.limit(0)).count() == 0


def test_resharding_reads_a_layout_only_if_named(spark):
    rng = random.Random(6)
    rows = [(None if i % 7 == 0 else i, sentences(rng, 30), i % 5) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, old_shard int")
    layout = resharding.Layout(shards=5, old_shards=5)
    one, two = resharding.resharded(docs, layout).collect(), resharding.resharded(docs.drop("old_shard"), layout).collect()
    key = lambda r: (r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, one)) == sorted(map(key, two))
    named = resharding.resharded(docs, layout, old="old_shard").collect()
    assert Counter(r.old_shard for r in named) == Counter(r[2] for r in rows) and len(named) == 300


def test_rewrite_moves_few_bytes_and_loses_no_row(spark, tmp_path):
    """A first version, then more shards, fewer shards and a change of one shard: each row once, only changed shards written."""
    rng = random.Random(9)
    rows = [(i if i % 9 else None, sentences(rng, rng.randint(1, 60)), "x") for i in range(400)] + [(7, None, None), (7, None, None)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "doc_id bigint, text string, size string").write.parquet(path)
    docs = spark.read.parquet(path)
    want = Counter((r[0], r[1]) for r in rows)

    def look(manifest, n: int) -> Counter:
        back = resharding.read_shards(manifest, docs)
        got = back.collect()
        assert Counter((r.doc_id, r.text) for r in got) == want and {r.shard for r in got} <= set(range(n))
        size = Counter()
        for r in got:
            assert r.size == len((r.text or "").encode()) + 16
            size[r.shard] += r.size
        assert len(size) == n and max(size.values()) < 1.1 * sum(size.values()) / n
        return size

    manifest = resharding.rewrite(docs, str(tmp_path / "out"), resharding.Layout(shards=8, old_shards=6))
    sizes = look(manifest, 8)
    for n in (11, 5):
        now = resharding.read_shards(manifest, docs).withColumnRenamed("shard", "home")
        moved = sum(r.size for r in resharding.resharded(now, resharding.Layout(shards=n), old="home").where("moved").collect())
        # no plan moves fewer bytes than what the shards hold beyond the new capacity; groups of equal texts cost a little
        least = sum(b if s >= n else max(0, b - sum(sizes.values()) / n) for s, b in sizes.items())
        assert moved <= least + 0.03 * sum(sizes.values())
        manifest = resharding.rewrite(now, str(tmp_path / "out"), resharding.Layout(shards=n), old="home", manifest=manifest)
        sizes = look(manifest, n)
    again = resharding.read_shards(manifest, docs).withColumnRenamed("shard", "home")
    same = resharding.rewrite(again, str(tmp_path / "out"), resharding.Layout(shards=5), old="home", manifest=manifest)
    before, after = ({r.shard: r.path for r in m.collect()} for m in (manifest, same))
    placed = resharding.resharded(again, resharding.Layout(shards=5), old="home").where("moved").collect()
    touched = {s for r in placed for s in (r.shard, r.old_shard)}
    assert {s for s in before if before[s] != after[s]} == touched
    look(same, 5)
    void = resharding.rewrite(docs.limit(0), str(tmp_path / "void"))
    assert resharding.read_shards(void, docs).count() == 0


def test_near_duplicates_by_sets_whatever_the_counts(spark):
    rng = random.Random(11)
    body, line = sentences(rng, 300), "all of this was sent from a phone on the way"
    other = sentences(rng, 300)
    rows = [(1, f"{body} {line}"), (2, f"{body} {' '.join([line] * 40)}"), (3, f"{other} {' '.join([line] * 25)}"), (4, f"{other} {' '.join([line] * 400)}"), (5, sentences(rng, 300))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.class_id for r in probminhash.classes(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_decontamination(spark):
    question = "On one fine day Alice went out and bought 12 red apples and 30 green pears at the small market, then Alice gave 5 kg of apples to her brother before noon"
    other = question.replace("Alice", "Maria").replace("12", "17").replace("30", "4,500").replace("5 kg", "9 pounds")
    broken = question.replace("then Alice", "then Maria")
    rows = [(1, f"some words before. {question}. and some after"), (2, f"intro {other} end"), (3, f"intro {broken} end"), (4, "nothing of that kind is here " * 20), (5, None), (6, ""), (None, question), (7, question), (7, "clean")]
    docs = spark.createDataFrame([(*r, None, None, 0, 0, "") for r in rows], SCHEMA)
    items = spark.createDataFrame([(1, question, 0), (2, "too short", 1), (3, None, 2), (None, "x", 3), (4, "12 14", 4)], "item_id bigint, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r.leaked for r in decontam.matches(docs, items).collect()}
    assert got == {(1, 1): True, (2, 1): True, (3, 1): True, (7, 1): True, (None, 1): True}
    none = docs.limit(1).selectExpr("cast(null as bigint) as doc_id", "'of no item' as text", "lang", "source", "n_chars", "n_words", "size")
    assert sorted(r.doc_id or 0 for r in decontam.clean(docs.unionByName(none), items).collect()) == [0, 4, 5, 6]
    few = decontam.Templates(broadcast_rows=1)  # the join by keys
    assert {(r.doc_id, r.item_id): r.leaked for r in decontam.matches(docs, items, few).collect()} == got
    assert decontam.matches(docs.limit(0), items).count() == 0 and decontam.matches(docs, items.limit(0)).count() == 0


def test_decontamination_judges_each_copy(spark):
    question = "On one fine day Alice went out and bought 12 red apples and 30 green pears at the small market, then Alice gave 5 kg of apples to her brother before noon"
    other = question.replace("Alice", "Maria").replace("12", "17")
    third = question.replace("Alice", "Peter").replace("12", "19")
    longer = lambda q: q.replace("apples and", "juicy apples and").replace("then", "and then")
    window = "and bought 99 red apples and 31 green pears"
    said = "That morning the old man said that he had seen 14 ships leave the harbour and that none of them came back"
    long = "Tom saw birds over a wide field near our river. " + " ".join(f"w{i}x" for i in range(60)) + " and Tom went home"
    rows = [(1, f"{question}. And again. {other}"), (2, f"{other} {third}"), (3, f"{question} and so on " + "far away " * 40 + window), (4, f"{longer(other)}. {'word ' * 30} {longer(third)}"),
            (5, said.replace("That morning", "This morning")), (6, long.replace("and Tom", "and Tim")), (7, question.replace("then Alice", "then Maria"))]
    docs = spark.createDataFrame([(*r, None, None, 0, 0, "") for r in rows], SCHEMA)
    items = spark.createDataFrame([(1, question), (2, said), (3, long)], "item_id int, text string")
    got = {(r.doc_id, r.item_id): r.leaked for r in decontam.matches(docs, items).collect()}
    assert got == {(1, 1): True, (2, 1): True, (3, 1): True, (4, 1): True, (5, 2): True, (6, 3): True, (7, 1): True}


def test_decontamination_of_items_rich_in_values(spark):
    texts = ["What is the capital of France?", "Who wrote Romeo and Juliet?", "What is 12 plus 35?", "Natalia sold 48 clips in April and 24 in May. How many altogether?",
             "On one fine day Alice went out and bought 12 red apples and 30 green pears at the small market",
             "Tom Sawyer met Huck Finn and Becky Thatcher near Hannibal in 1844, then the four of them went down to the river before noon"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id int, text string")
    around = lambda t: f"some words here, {t} and other words there"
    cases = [str, str.lower, str.upper, str.title]
    rows = [(10 * i + j, around(case(t))) for i, t in enumerate(texts) for j, case in enumerate(cases)]
    other = texts[5].replace("Huck Finn", "Joe Harper").replace("1844", "1851")
    rows += [(100, around(other)), (101, "What is the price of 12 plus nothing. Who wrote that and why?"), (102, "Nobody sold clips in the month of May. How many altogether then?")]
    docs = spark.createDataFrame([(*r, None, None, 0, 0, "") for r in rows], SCHEMA)
    got = {(r.doc_id, r.item_id) for r in decontam.matches(docs, items).where("leaked").collect()}
    assert got == {(10 * i + j, i) for i in range(6) for j in range(4)} | {(100, 5)}


def test_licenses(spark):
    rows = [("a", "p/LICENSE", "Released under the MIT License.", True), ("b", "p/q/x.txt", "plain", False), ("c", "p/q/y.txt", "Text.\nLicensed under the Apache License, Version 2.0. More", False), ("d", "z.txt", None, False), ("e", None, "", False),
            ("f", "p/q/r/s/t.txt", "copyright of nobody known", False), ("g", "p/q/LICENSE", "Licensed under CC BY-NC 4.0.", True), ("h", "pq/x", "plain", False)]
    files = spark.createDataFrame(rows, "file string, path string, text string, is_license boolean")
    got = {r.file: (r.license, r.basis, r.from_dir) for r in license_scan.licensed(files).collect()}
    assert got == {"a": ("MIT", "own", None), "b": ("CC-BY-NC-4.0", "inherited", "p/q"), "c": ("Apache-2.0", "own", None), "d": (None, "none", None), "e": (None, "none", None),
                   "f": ("CC-BY-NC-4.0", "inherited", "p/q"), "g": ("CC-BY-NC-4.0", "own", None), "h": (None, "none", None)}
    assert license_scan.licensed(files.limit(0)).count() == 0


HEADERS = {
    "Apache-2.0": """#!/usr/bin/env python
# Copyright 2021 The Project Authors.
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
import os""",
    "BSD-3-Clause": """// Copyright (c) 2014 Some Body. All rights reserved.
// Use of this source code is governed by a BSD-style license that can be
// found in the LICENSE file.

package main""",
    "MPL-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */

int main;""",
    "GPL-3.0": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,""",
    "ISC": """ * Copyright (c) 2004 Some One
 *
 * Permission to use, copy, modify, and distribute this software for any
 * purpose with or without fee is hereby granted, provided that the above
 * copyright notice and this permission notice appear in all copies.
 *
 * THE SOFTWARE IS PROVIDED""",
    "MIT": """MIT License

Copyright (c) 2020 A Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights""",
}


def test_wrapped_license_headers(spark):
    rows = [(name, f"src/{name}.x", text, False, "clash") for name, text in HEADERS.items()] + [("MIT", "src/again.x", HEADERS["MIT"], False, "clash"), ("long", "src/l.x", "words of no use here. " * 40_000 + "\n\n" + HEADERS["GPL-3.0"], False, "clash")]
    rows += [("prose", "src/p.x", "The license of a pilot has a version in blue, and the terms of use are on the back of it. Nothing is granted.", None, "clash")]
    files = spark.createDataFrame(rows, "file string, path string, text string, is_license boolean, license string")
    got = Counter((r.file, r.license) for r in license_scan.licensed(files).collect())
    want = Counter({(name, name): 1 for name in HEADERS})
    want["MIT", "MIT"] = 2
    assert got == want + Counter({("long", "GPL-3.0"): 1, ("prose", None): 1})


def test_license_filter_loses_no_match(spark):
    """The terms of which a match needs one, against the cosine of random mixes of template words."""
    import math
    import re

    rng, model = random.Random(8), license_scan.Model()
    by_part: dict = {}
    for name, part, term, w in model.vectors:
        by_part.setdefault((name, part), {})[term] = w
    texts, cases = [t for x in license_scan.TEMPLATES.values() for t in x], []
    for _ in range(3000):
        words = re.findall(license_scan.TERM, rng.choice(texts).lower())
        words = [w for w in words if rng.random() < rng.choice((0.3, 0.8))] + ["foreign"] * rng.randint(0, 2)
        own = {t: (1 + math.log(n)) * model.idf.get(t, model.foreign) for t, n in Counter(words).items()}
        norm = math.sqrt(sum(w * w for w in own.values())) or 1
        best = max(sum(own.get(t, 0) * w for t, w in v.items()) / norm for v in by_part.values())
        assert best < license_scan.THRESHOLD or re.search(model.pattern, " ".join(words))
        cases.append((words, best))
    bound = [r[0] or 0.0 for r in spark.createDataFrame(cases, "w array<string>, b double").coalesce(1).select(license_scan.known_part(F.col("w"), model)).collect()]
    assert all(b >= best - 1e-9 for b, (_, best) in zip(bound, cases, strict=True))


def test_empty_tables(empty):
    assert phrase_automata.cleaned(empty).count() == 0
    assert suffix_dedup.cleaned(empty).count() == 0
    assert probminhash.classes(empty).count() == 0
    assert quality_ledger.ledger(empty).count() == 0


#: Columns that the queries promise, in any order; more may follow.
CONTRACT = {
    "op2_url_reputation": "page_id host path rule verdict",
    "op3_quality_ledger": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op5_chat_prefix": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op9_flow_resharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op11_block_max_search": "item_id rank doc_id score",
    "op12_hnsw_search": "query_id rank vec_id score",
    "op13_vector_codes": "vec_id code error label_error codebooks_sha256",
}


def test_queries_have_contract_columns(spark):
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    for name, columns in CONTRACT.items():
        assert set(columns.split()) <= set(queries.QUERIES[name](spark, "/root/testdata/sf0.001").columns), name

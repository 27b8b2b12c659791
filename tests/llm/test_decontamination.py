"""Templates, windows and slots against a brute-force version on random documents."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import pairwise

import regex

from lemmaweave.llm import decontam

N, A, U = decontam.NUMBER, decontam.NAME, decontam.UNIT


def split(text: str) -> list[str]:
    return regex.sub(r"[^\p{L}\p{N}-]+", " ", text).strip(" ").lower().split(" ")


def words_of(text: str) -> tuple[list[str], list[str]]:
    """(templates, words): as many of the one as of the other."""
    base = regex.sub(r"(?<=\p{Nd})[.,](?=\p{Nd})", "", text)
    t = regex.sub(r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}+(?![\p{L}\p{N}])", A, base)
    t = regex.sub(r"(?<![\p{L}\p{N}])\p{Nd}+(?![\p{L}\p{N}])", N, t)
    t = regex.sub(rf"(?<={N})([^\p{{L}}\p{{N}}{N}{A}]{{1,3}})(?:{'|'.join(decontam.UNITS)})(?![\p{{L}}\p{{N}}])", rf"\1{U}", t)
    return split(t), split(base)


def verdict(doc: str, item: str, s: decontam.Templates) -> bool | None:
    """Whether the document leaks the item, None if too little of it is found."""
    (dt, dw), (t, w) = words_of(doc), words_of(item)
    k = min(len(t), s.window)
    starts = range(len(t) - k + 1)
    literal = [sum(x not in (N, A, U) for x in t[i : i + k]) >= min(s.literal, k) for i in starts]
    hits = {(i, j) for i in starts for j in range(len(dt) - k + 1) if (literal[i] and t[i : i + k] == dt[j : j + k]) or w[i : i + k] == dw[j : j + k]}
    need = min(s.hits, len(starts))
    if not hits or len({i for i, _ in hits}) + literal.count(False) < need:
        return None
    found = []  # document order, item order, searched, equal, pairs
    for shift in {j - i for i, j in hits}:
        for i in starts:
            if i + shift >= 0 and i + shift + k <= len(dt) and all(t[x] == dt[x + shift] or w[x] == dw[x + shift] for x in range(i, i + k)):
                pairs = [(t[x] in (N, A, U), w[x], dw[x + shift]) for x in range(i, i + k)]
                found.append((i + shift, i, literal[i] and t[i : i + k] == dt[i + shift : i + shift + k], all(a == b for _, a, b in pairs), pairs))
    found.sort()
    groups, chain = defaultdict(list), 0
    for last, x in pairwise([None, *found]):
        if last is None or not (x[1] > last[1] and abs((x[0] - x[1]) - (last[0] - last[1])) <= k):
            chain += 1
        for key in (("alignment", x[0] - x[1]), ("chain", chain), ("document", 0)):
            groups[key].append(x)
            if x[2]:
                groups["templates", *key].append(x)
    out = None
    for rows in groups.values():
        if len({x[1] for x in rows}) < need:
            continue
        votes = Counter((slot, a, b) for x in rows if not x[3] for slot, a, b in x[4])
        agree = True
        for side in (1, 2):
            by = defaultdict(Counter)
            for vote, n in votes.items():
                by[vote[0], vote[side]][vote] += n
            agree &= all(len(c) == 1 for c in by.values())
        out = bool(out) or agree or len({x[1] for x in rows if x[3]}) >= need
    return out


def test_decontamination_against_brute_force(spark):
    rng = random.Random(8)
    common = [f"w{chr(97 + i)}" for i in range(20)]
    names, numbers, units = ["Anna", "Bert", "Carl", "Dora"], ["3", "14", "1,500", "2.5"], ["kg", "hours", "miles"]

    def sentence(n: int) -> list[str]:
        out = []
        for _ in range(n):
            out += [rng.choice([*common * 2, *names, *numbers])]
            if out[-1] in numbers and rng.random() < 0.5:
                out.append(rng.choice(units))
        return out

    items = [sentence(rng.choice([5, 9, 18, 30])) for _ in range(14)]
    docs = []
    for number in range(160):
        words = list(rng.choice(items))
        kind = number % 5
        if kind in (1, 2):  # other values, the same everywhere or not
            to = {x: rng.choice(names) for x in names} | {x: rng.choice(numbers) for x in numbers}
            words = [(to.get(x, x) if kind == 1 or rng.random() < 0.7 else x) for x in words]
        if kind == 3:
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(common)
        if kind == 4:
            words = words[: len(words) * 2 // 3] + sentence(2) + words[len(words) // 2 :]
        docs.append(" ".join([*sentence(rng.randint(0, 12)), *words, *sentence(rng.randint(0, 12))]))
    settings = decontam.Templates()
    want = {(i, j): x for i, d in enumerate(docs) for j, item in enumerate(items) if (x := verdict(d, " ".join(item), settings)) is not None}
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").repartition(3)
    asked = spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id int, text string")
    got = {(r.doc_id, r.item_id): r.leaked for r in decontam.matches(table, asked, settings).collect()}
    assert got == want and 20 < sum(want.values()) < len(want)

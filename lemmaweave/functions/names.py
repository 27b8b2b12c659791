"""Names of results in prose: a kind word and the numbers behind it."""

from __future__ import annotations

import re

#: Kinds of results that prose names (fixed values).
KINDS = ("theorem", "lemma", "proposition", "corollary", "definition", "claim", "conjecture", "example", "remark")
#: What a proof says before it names what it still has to prove (fixed values).
ANNOUNCEMENTS = (
    "it remains to prove", "it suffices to prove", "the proof divided into", "the proof is divided into", "the proof is reduces to", "the proof reduces to",
    "we first prove", "we next prove", "we now prove", "we prove", "we shall prove",
)
_WORD = re.compile(r"[A-Za-z]+")
_NUMBER = re.compile(r"[A-Za-z]?\d+(?:\.\d+)*|[A-Z](?![A-Za-z0-9])")
_JOINT = re.compile(r"\s*(?:,\s*and\b|,|and\b)\s*")
_GAP = re.compile(r"[\s~]+")


def kind_of(word: str) -> str | None:
    """The kind a word names, in singular or plural."""
    w = word.lower()
    return next((k for k in KINDS if w in (k, k + "s", k[:-1] + "ies")), None)


def number_list(text: str, at: int) -> list[tuple[str, int, int]]:
    """(number, start, end) of a list with commas and 'and' that begins at a place."""
    out: list[tuple[str, int, int]] = []
    while (m := _NUMBER.match(text, at)) is not None and not text[m.end() : m.end() + 1].isalpha():
        out.append((m[0], m.start(), m.end()))
        joint = _JOINT.match(text, m.end())
        if joint is None:
            break
        at = joint.end()
    return out


def named(text: str) -> list[dict]:
    """Results named by kind and number: kind, number, start, end, raw, place (of the number)."""
    out = []
    for w in _WORD.finditer(text):
        kind, gap = kind_of(w[0]), _GAP.match(text, w.end())
        if kind is None or gap is None or text[w.start() - 1 : w.start()] == "\\":
            continue
        out += [{"kind": kind, "number": number, "start": w.start(), "end": end, "raw": f"{w[0]} {number}", "place": start} for number, start, end in number_list(text, gap.end())]
    return out


def announcements(text: str) -> list[int]:
    """Where an announcement ends, for each one in the text."""
    words = [(w[0].lower(), w.start(), w.end()) for w in _WORD.finditer(text)]
    out = []
    for phrase in ANNOUNCEMENTS:
        want = phrase.split()
        for i in range(len(words) - len(want) + 1):
            part = words[i : i + len(want)]
            if [w for w, _, _ in part] == want and all(text[a[2] : b[1]].isspace() for a, b in zip(part, part[1:], strict=False)):
                out.append(part[-1][2])
    return sorted(out)


def sentence(text: str, at: int, most: int) -> str:
    """The text from a place to the end of its sentence; a dot between digits ends none."""
    part = text[at : at + most]
    for i, c in enumerate(part):
        if c == ";" or (c == "." and not (part[i - 1 : i].isdigit() and part[i + 1 : i + 2].isdigit())):
            return part[:i]
    return part

"""Reading proof prose: what it cites, which results it names, and where.

The scanner walks over words and brackets; it knows three shapes: a kind word
with numbers behind it, a bracket with a key and perhaps a place, and a citation
command whose options may name a place.  Offsets are characters of the text.
"""

from __future__ import annotations

import re

from . import tex
from .names import named

#: Displayed mathematics (fixed values).
MATH = ("align", "alignat", "displaymath", "eqnarray", "equation", "gather", "math", "multline")


def math_ranges(text: str) -> list[tuple[int, int]]:
    """Ranges between dollars, in \\( \\), \\[ \\] and in displayed environments; an open one has no range."""
    out: list[tuple[int, int]] = []
    closers = {"\\(": "\\)", "\\[": "\\]", "$$": "$$", "$": "$"}
    i = 0
    while i < len(text):
        two, one = text[i : i + 2], text[i]
        opener = two if two in closers else one if one in closers else None
        if opener is None:
            i += 2 if one == "\\" else 1
            continue
        end = i + len(opener)
        while (end := text.find(closers[opener], end)) > 0 and text[end - 1] == "\\" and opener[0] == "$":
            end += 1
        if end < 0:
            i += len(opener)
            continue
        out.append((i, end + len(closers[opener])))
        i = out[-1][1]
    for b in tex.environments(text, {m + star for m in MATH for star in ("", "*")}, text):
        out.append((b.start, b.end))
    for _, _, start, end in tex.commands(text, ("ensuremath",)):
        g = tex.group(text, end)
        out.append((start, g[1] if g else end + 1))
    return out


def _place(text: str) -> tuple[str | None, str | None]:
    """(kind, number) of the one result that a locator names."""
    found = named(text.replace("~", " "))
    return (found[0]["kind"], found[0]["number"]) if len(found) == 1 else (None, None)


def citations(text: str, is_tex: bool = True) -> list[dict]:
    """Citation commands and brackets: method, key, raw, start, end, kind and number of a locator, and whether a
    bracket is sure (plain) even if no entry has its key."""
    out = []
    scan = tex.mask(text) if is_tex else text
    taken: list[tuple[int, int]] = []
    if is_tex:
        for word, star, start, end in tex.commands(scan, tex.CITATIONS):
            at = tex.options(scan, end)
            g = tex.group(scan, at)
            if g is None:
                continue
            taken.append((start, g[1]))
            kind, number = _place(scan[end:at])
            for key in (k.strip() for k in g[0].split(",")):
                if key:
                    out.append({"method": "command", "key": key, "raw": scan[start : g[1]], "start": start, "end": g[1], "kind": kind, "number": number, "sure": True})
        taken += math_ranges(scan)
        for _, _, _, end in tex.commands(scan):
            stop = tex.options(scan, end)
            if stop > end:
                taken.append((end, stop))
    for m in re.finditer(r"\[([^\[\],]+)(?:,([^\[\]]*))?\]", scan):
        if any(a < m.end() and m.start() < b for a, b in taken) or (is_tex and scan[m.start() - 1 : m.start()] in ("\\", "=") and m.start()):
            continue
        kind, number = _place(m[2] or "")
        if m[2] is not None and kind is None:
            continue
        out.append({"method": "bracket", "key": m[1].strip(), "raw": m[0], "start": m.start(), "end": m.end(), "kind": kind, "number": number, "sure": not is_tex or kind is not None})
    return sorted(out, key=lambda x: (x["start"], x["key"]))

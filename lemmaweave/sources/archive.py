"""Safe reading of source packages and choice of the main file.  Runs where a package is received, never in a query."""

from __future__ import annotations

import gzip
import io
import tarfile

MEMBERS, BYTES = 10_000, 500 << 20
#: Names tried first, in order (fixed values).
PREFERRED = ("main.tex", "paper.tex", "ms.tex", "article.tex")


class Unsafe(ValueError):
    """A package that leaves its folder or exceeds its limits."""


def _read(stream, left: int) -> bytes:  # noqa: ANN001
    data = stream.read(left + 1)
    if len(data) > left:
        raise Unsafe("package too large")
    return data


def unpack(package: bytes, members: int = MEMBERS, most: int = BYTES) -> dict[str, str]:
    """path -> text of a tar (any compression), gzip or plain TeX package; links and outside paths are errors."""
    files: dict[str, str] = {}
    try:
        tar = tarfile.open(fileobj=io.BytesIO(package))
    except tarfile.ReadError:
        tar = None
    if tar is None:
        plain = _read(gzip.GzipFile(fileobj=io.BytesIO(package)), most) if package[:2] == b"\x1f\x8b" else package
        if len(plain) > most:
            raise Unsafe("package too large")
        if b"\\documentclass" not in plain:
            raise ValueError("neither an archive nor TeX")
        return {"main.tex": plain.decode("utf-8", "replace")}
    with tar:
        for count, m in enumerate(tar, 1):
            parts = m.name.split("/")
            if count > members:
                raise Unsafe("too many members")
            if m.name.startswith("/") or ".." in parts or not (m.isfile() or m.isdir()):
                raise Unsafe(f"member {m.name}")
            if m.isfile():
                data = _read(tar.extractfile(m), most)
                most -= len(data)
                files["/".join(p for p in parts if p not in ("", "."))] = data.decode("utf-8", "replace")
    return files


def main_file(files: dict[str, str], wanted: str | None = None) -> str:
    """The root document: the wanted one, a preferred name, or the only one."""
    from ..functions import tex

    roots = sorted(p for p, t in files.items() if p.endswith(".tex") and {"documentclass", "begin"} <= {w for w, _, _, _ in tex.commands(tex.mask(t), ("documentclass", "begin"))} and "\\begin{document}" in tex.mask(t))
    if wanted is not None:
        if wanted not in files:
            raise FileNotFoundError(wanted)
        return wanted
    named = [p for p in PREFERRED if p in roots]
    if named or len(roots) == 1:
        return (named or roots)[0]
    raise ValueError(f"{len(roots)} root documents: {', '.join(roots)}")

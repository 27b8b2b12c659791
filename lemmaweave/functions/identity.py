"""Identities of papers and references."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import unquote, urlsplit

_ARXIV = re.compile(r"(?i)(\d{4}\.\d{4,5}|[a-z][a-z0-9.-]*/\d{7})(v[1-9]\d*)?")
#: What an identifier may be wrapped in (fixed values).
_WRAPPED = re.compile(r'<(.*)>|\[(.*)\]|"(.*)"|\((.*)\)', re.DOTALL)
_BLANKS = re.compile(r"\s+")


def folded(text: str | None) -> str:
    """Compatibility form, case folded, white space collapsed."""
    form = unicodedata.normalize("NFKC", text or "")
    return _BLANKS.sub(" ", form.casefold()).strip()


def arxiv(text: str | None) -> tuple[str | None, str | None]:
    """(identifier without version, version) of an identifier or an arXiv address; (None, None) if it is neither."""
    value = (text or "").strip()
    if value.lower().startswith(("http://", "https://")):
        at = urlsplit(value)
        if at.netloc.lower().removeprefix("www.") != "arxiv.org" or not re.match(r"/(abs|pdf)/", at.path):
            return None, None
        value = at.path.split("/", 2)[2].removesuffix(".pdf")
    value = re.sub(r"(?i)^arxiv:\s*", "", value)
    m = _ARXIV.fullmatch(value)
    return (m[1].lower(), m[2].lower() if m[2] else None) if m else (None, None)


def _address(text: str) -> tuple[str, str, list[str]]:
    """(host, path, warnings) of a web address; empty for other texts."""
    if "://" not in text[:9] or not text.lower().startswith("http"):
        return "", "", []
    at = urlsplit(text)
    extra = any((at.username, at.password, at.query, at.fragment))
    return at.netloc.lower(), at.path, ["identifier_url_components"] if extra else []


def _doi(text: str, _: str | None) -> tuple[str | None, str | None, list[str]]:
    host, path, _ = _address(text)
    if host:
        text = unquote(path[1:]) if host in DOI_HOSTS else ""
    front, slash, name = re.sub(r"(?i)^doi:\s*", "", text).casefold().partition("/")
    registrant = front.removeprefix("10.")
    if not slash or registrant == front or not (registrant.isdigit() and 4 <= len(registrant) <= 9) or not name or set(name) & DOI_NEVER or any(c.isspace() for c in name):
        return None, None, []
    doubtful = name[-1] in ".,;:" or name.count("(") != name.count(")")
    return f"{front}/{name}", None, ["ambiguous_identifier_punctuation"] if doubtful else []


def _arxiv(text: str, version: str | None) -> tuple[str | None, str | None, list[str]]:
    name, own = arxiv(text)
    if name is None or (version and not re.fullmatch(r"v[1-9]\d*", version)):
        return None, None, []
    return name, own or version, ["version_conflict"] if version and own and own != version else []


#: Hosts of DOI addresses and characters that no DOI has (fixed values).
DOI_HOSTS, DOI_NEVER = ("doi.org", "dx.doi.org"), set('<>"{}')
PARSERS = {"arxiv": _arxiv, "doi": _doi}


def identifier(value: str | None, kind: str, version: str | None = None) -> dict:
    """canonical, identity, version, valid, exact_eligible and warnings of a DOI or arXiv identifier (keys and words: fixed values)."""
    text = (value or "").strip()
    while wrapped := _WRAPPED.fullmatch(text):
        text = wrapped[wrapped.lastindex].strip()
    canonical, own, doubts = PARSERS[kind](text, version)
    warnings = sorted({*_address(text)[2], *doubts, *([] if canonical else ["invalid_identifier"])})
    return {"kind": kind, "raw": value, "canonical": canonical, "identity": canonical and f"{kind}:{canonical}", "version": own, "valid": canonical is not None,
            "exact_eligible": canonical is not None and not warnings, "warnings": warnings}

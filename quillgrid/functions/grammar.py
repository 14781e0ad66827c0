"""The schema language: matchers in inline code, their extras, curly matchers.

Compiled once on the driver.  Patterns are anchored at the start only, and the
anchor binds to the first alternative, as in ``^a|b``.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import regex as engine  # on every machine: the standard library reads some classes otherwise

_NAME = r"[A-Za-z0-9_-]+"
_INSIDE = re.compile(rf"(?:(?P<id>{_NAME}):)?/(?P<re>.+)/|(?P<bare>{_NAME})", re.DOTALL)
_EXTRAS = re.compile(r"!|[+{},0-9]+")
_RANGE = re.compile(r"\{(\d*),(\d*)\}")
_CURLY = re.compile(r"\{(.+?)\}(.*)", re.DOTALL)
_CURLY_ID = re.compile(r"\{(\w+)\}")
#: Look-around, back-references and possessive forms have no linear-time match.
_REFUSED = re.compile(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\\k<|\(\?P=|[*+?}]\+")


class MatcherError(ValueError):
    """code: InteriorRegexInvalid, MixedLiteralAndOthers, WasLiteralCode."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass(frozen=True)
class Matcher:
    id: str | None
    pattern: str | None  # without the anchor; None takes the whole text
    least: int | None = None
    most: int | None = None
    ranged: bool = False

    @property
    def repeated(self) -> bool:
        return self.ranged

    @property
    def variable(self) -> bool:
        return self.ranged and not (self.least is not None and self.least == self.most)

    @property
    def shown(self) -> str:
        """The pattern as errors show it."""
        return self.id or "" if self.pattern is None else f"^{self.pattern}"

    def match(self, text: str) -> str | None:
        if self.pattern is None:
            return text
        found = compiled(self.pattern).search(text)
        return found.group(0) if found else None

    def __str__(self) -> str:
        body = "" if self.pattern is None else f"/{self.pattern}/"
        return ":".join(x for x in (self.id, body) if x)


@functools.lru_cache(4096)
def compiled(pattern: str):
    return engine.compile("^" + pattern)


def split_extras(text: str) -> tuple[str, str]:
    """What of the text after a matcher is extras, and what is literal suffix."""
    found = _EXTRAS.match(text)
    at = found.end() if found else 0
    return text[:at], text[at:]


@functools.lru_cache(4096)
def matcher(inside: str, after: str = "") -> Matcher:
    """The matcher of inline code ``inside`` that ``after`` follows."""
    extras, rest = split_extras(after)
    if extras.startswith("!"):
        if _EXTRAS.match(rest):
            raise MatcherError("MixedLiteralAndOthers", extras + rest[:1])
        raise MatcherError("WasLiteralCode")
    found = _INSIDE.fullmatch(inside.strip())
    if not found:
        raise MatcherError("InteriorRegexInvalid", inside)
    name = found["bare"] or found["id"]
    if found["re"] is not None:
        if _REFUSED.search(found["re"]):
            raise MatcherError("InteriorRegexInvalid", f"not supported: {found['re']}")
        try:
            compiled(found["re"])
        except Exception as wrong:
            raise MatcherError("InteriorRegexInvalid", str(wrong)) from None
    span = _RANGE.search(extras)
    bound = lambda k: int(span[k]) if span and span[k] else None
    return Matcher(name, found["re"], bound(1), bound(2), span is not None)


def curly(text: str) -> Matcher | None:
    """The matcher of ``{id:/re/}`` text, or None where it isn't such text."""
    found = _CURLY.fullmatch(text)
    return matcher(found[1], found[2] or "") if found and ("/" in found[1]) else None


def curly_id(text: str) -> str | None:
    found = _CURLY_ID.fullmatch(text)
    return found[1] if found else None

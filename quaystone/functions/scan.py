"""Spans of texts in time linear to their length: find a mark, grow from it,
verify what was grown. Shared by masking and by the text of pages."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Labels of a domain, with dots between them; nothing follows that could make it go back.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
_LETTERS = re.compile(r"[A-Za-z]{2,}")


def email_spans(text: str) -> Iterator[Span]:
    """Mail addresses, left to right, none overlapping: grown from each at sign
    to the left over what may stand there, to the right over the labels of a
    domain, whose last one begins with two letters at least."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            dot = text.rfind(".", at + 2, domain.end())
            while dot >= 0:
                top = _LETTERS.match(text, dot + 1, domain.end())
                if top:
                    yield start, top.end()
                    free = top.end()
                    break
                dot = text.rfind(".", at + 2, dot)
        at = text.find("@", max(at + 1, free))


def replaced(text: str, spans: Iterable[Span], by: str) -> str:
    """text with by in place of each span."""
    out, done = [], 0
    for start, end in spans:
        out += (text[done:start], by)
        done = end
    return "".join([*out, text[done:]]) if out else text


def replaced_if(text: str, pattern: re.Pattern, holds: Callable[[str], bool], by: str) -> str:
    """text with by in place of the finds that hold; the others stay whole."""
    return replaced(text, (m.span() for m in pattern.finditer(text) if holds(m[0])), by)


_OPENS = re.compile(r"<(script|style)\b", re.I | re.A)
_CLOSES = {name: re.compile(rf"</{name}\s*>", re.I | re.A) for name in ("script", "style")}
_BREAKS = re.compile(r"<br\s*/?>|</(?:p|div|tr)\s*>", re.I | re.A)
_TAG = re.compile("<[^>]*>")


def hidden_spans(page: str) -> Iterator[Span]:
    """Script and style elements that are closed, with their tags."""
    closed = dict.fromkeys(_CLOSES, True)
    opens = _OPENS.search(page)
    while opens and any(closed.values()):
        name, resume = opens[1].lower(), opens.end()
        if closed[name]:
            end = _CLOSES[name].search(page, opens.end())
            if end:
                yield opens.start(), end.end()
                resume = end.end()
            else:
                closed[name] = False  # nor will a later one be
        opens = _OPENS.search(page, resume)


def page_text(page: str) -> str:
    """A page without scripts and styles, a line end for each break and end of
    a block, tags dropped."""
    text = _BREAKS.sub("\n", replaced(page, hidden_spans(page), ""))
    last = text.rfind(">") + 1  # beyond it no tag ends, so none is looked for
    return _TAG.sub("", text[:last]) + text[last:]

"""Cutting texts where a byte-level tokenizer surely cuts them, so that pieces can be looked up.

The public pattern starts a match at every single space before other characters and never lets a
match run from other characters into white space. Cutting there leaves the matches, and so the
ids, of a text unchanged: they are those of its pieces in order.
"""

from __future__ import annotations

import re

# The white space of the pattern (the Unicode property).
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
_COARSE = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_ODD = ("  ", " \n", "\n ", "\n\n", "\0", *[c for c in WHITE if c not in " \n"])


def marked(text: str) -> str | None:
    """The text with a zero byte between its pieces; none if that does not do."""
    if any(x in text for x in _ODD) or text[:1] == " " or text[-1:] in (" ", "\n"):
        return None
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0")


def cut(text: str) -> list[str]:
    """Pieces whose concatenation is the text; no match of the pattern spans two of them."""
    found = marked(text)
    return _COARSE.findall(text) if found is None else found.split("\0")

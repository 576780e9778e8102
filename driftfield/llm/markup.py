"""One tokenizer for pages: tags, attributes and character references, in time that grows with the page and no faster."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

#: Elements whose inside is characters up to their end tag.
RAW = frozenset("script style title iframe noembed noframes noscript textarea".split())

_TOKEN = re.compile(r"""<(?:!--(?P<comment>.*?)(?:-->|\Z)|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|(?P<broken>/?[a-zA-Z][^>]*)(?:>|\Z)|(?P<odd>[!?/][^>]*)(?:>|\Z))""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]++)(?:\s*+=\s*+(?:"([^"]*)"?|'([^']*)'?|([^\s>"']++)))?""")
_CLOSES = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE) for tag in RAW}
#: Numeric references beyond the last code point, and zeros before a number: a number of thousands of digits is refused by Python.
_BEYOND = re.compile(r"&#(?:[xX]0*+[0-9a-fA-F]{7,}+|0*+[0-9]{8,}+);?")
_ZEROS = re.compile(r"&#([xX]?)0{8,}+")


def decoded(text: str) -> str:
    """Character references as characters; those of no code point become the replacement character."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _ZEROS.sub(r"&#\g<1>0", _BEYOND.sub("�", text))
    return html.unescape(text)


def attributes(rest: str) -> Iterator[tuple[str, str]]:
    """(name in lower case, value as written) of what follows a tag's name; no value is the empty one."""
    for m in _ATTRIBUTE.finditer(rest):
        yield m[1].lower(), m[2] or m[3] or m[4] or ""


def tokens(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """The page in order, as (text, tag, whether it is an end tag, what follows the tag's name): text runs have the tag
    ``""``; tags have no text, but those of ``RAW`` elements, which come once, with their inside as text; comments have the
    tag ``!``. A tag that is cut off or broken says nothing."""
    at, n, search = 0, len(page), _TOKEN.search
    while at < n:
        m = search(page, at)
        begin = m.start() if m else n
        if begin > at:
            yield page[at:begin], "", False, ""
        if not m:
            return
        at = m.end()
        tag = m["tag"]
        if tag is None:
            yield "", "!", False, ""
            continue
        tag, end = tag.lower(), bool(m["end"])
        if tag in RAW and not end:
            close = _CLOSES[tag].search(page, at)
            inside = page[at : close.start()] if close else page[at:]
            at = close.end() if close else n
            yield inside, tag, False, m["rest"]
        else:
            yield "", tag, end, m["rest"]

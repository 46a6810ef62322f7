"""Python forms of functions that also run inside Python workers."""

from __future__ import annotations

import re

from passage_engine.functions.text import ABBREVIATIONS

_END = re.compile(r"([.!?…][\"'”’)\]]*)\s+")
_GUARD = re.compile(r"(?i:" + "|".join(map(re.escape, ABBREVIATIONS)) + r")\.|(?:[A-Z]\.)+")


def sentence_list(text: str) -> list[str]:
    """Sentences of a text; see ``text.sentences``."""
    out = []
    for paragraph in re.split(r"\n\s*\n", text.strip()):
        flat, start = " ".join(paragraph.split()), 0
        for m in _END.finditer(flat):
            last = flat[start : m.start() + 1].rsplit(" ", 1)[-1]
            if m[1] == "." and _GUARD.fullmatch(last):
                continue
            out.append(flat[start : m.end(1)])
            start = m.end()
        out.append(flat[start:])
    return [s for s in out if s]

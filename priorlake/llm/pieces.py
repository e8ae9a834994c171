"""Cutting texts at blanks where a byte-level tokenizer's word pattern always cuts too."""
from __future__ import annotations

import re

# A blank between two white-space characters (or at the end after one) need not be a cut.
UNSURE = re.compile(r"\s (?:\s|$)")


def pieces(text: str) -> list[str] | None:
    """The parts between blanks; every part but the first begins with its blank, which is left out. None: not cuttable.

    The word pattern attaches one blank to the word that follows it, so a blank next to a non-space character
    always starts a word, and words never look across such a cut.
    """
    return None if UNSURE.search(text) else text.split(" ")

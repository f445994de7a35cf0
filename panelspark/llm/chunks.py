"""Texts as sequences of space-led chunks, so that encodings can be remembered by chunk.

With the pre-token pattern of byte-level BPE, a space right before a character
that is no white space always starts a pre-token, and what lies left of it
splits the same with or without it. So a text may be cut there, and each chunk
encoded alone.
"""

from __future__ import annotations

import re

#: White space after a space, or a space at the end: such texts are cut by pattern.
ODD_SPACE = re.compile(r" (?=\s|\Z)")
CUT = re.compile(r" (?=\S)")


def cut(text: str) -> tuple[str, list[str]]:
    """The first chunk, and the further chunks without the space that leads each."""
    parts = CUT.split(text) if ODD_SPACE.search(text) else text.split(" ")
    if parts and not parts[0] and len(parts) > 1:  # the text begins with a space
        return " " + parts[1], parts[2:]
    return parts[0], parts[1:]

"""Byte-level BPE on whole texts: chunks between single spaces are encoded once and remembered."""

from __future__ import annotations

import base64
import re
import sys
from array import array

#: Encoded chunks that a Python worker remembers; beyond it, the memory starts afresh.
REMEMBERED = 400_000
#: Longer chunks are not remembered.
LONGEST_REMEMBERED = 80


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def little_endian(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


#: A space with white space before and after it (or the end): the pattern takes it together with its neighbours.
#: Judged by single bytes of UTF-8, so some harmless spaces are found as well; their texts are encoded as a whole.
INNER_SPACE = re.compile(rb" (?<=[\t-\r\x1c-\x20\x80-\x8a\x9f\xa0\xa8\xa9\xaf] )(?:[\t-\r\x1c-\x20\xc2\xe1-\xe3]|\Z)")


class Chunks(dict):
    """Ids, as little-endian unsigned 32-bit bytes, of a chunk after a space.

    The pattern of the tokenizers starts a new match at every single space, unless other white space stands before and
    after it, so the chunks of a text at its single spaces can be encoded one by one. A text with two spaces in a row,
    or with a space inside other white space, is encoded as a whole.
    """

    def __init__(self, encode):
        super().__init__()
        self.encode = encode  # bytes of text -> list of ids

    def ids(self, text: bytes) -> bytes:
        return little_endian(self.encode(text))

    def __missing__(self, chunk: bytes) -> bytes:
        found = self.ids(b" " + chunk)
        if len(chunk) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = found
        return found

    def of(self, text: bytes) -> bytes:
        """Ids of a whole text."""
        if b"  " in text or INNER_SPACE.search(text):
            return self.ids(text)
        first, *rest = text.split(b" ")
        return self.ids(first) + b"".join(map(self.__getitem__, rest))

"""Terms as lexical search and resampling read them: runs of ASCII letters and digits and of all characters beyond ASCII."""

from __future__ import annotations

import zlib

#: Each byte of a text in UTF-8: A-Z become a-z, other ASCII characters than letters and digits become blanks; bytes beyond ASCII stay.
TABLE = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Terms whose bucket a Python worker keeps; beyond it the store starts anew.
CACHE = 200_000


def terms(text: bytes) -> list[bytes]:
    """The maximal matches of [^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+, A-Z in lower case; split() of bytes knows ASCII blanks only."""
    return text.translate(TABLE).split()


class Buckets(dict):
    """The CRC-32 of a feature, modulo the number of buckets; short features are kept."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, feature: bytes) -> int:
        found = zlib.crc32(feature) % self.size
        if len(feature) < 40:
            if len(self) >= CACHE:
                self.clear()
            self[feature] = found
        return found

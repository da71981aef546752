"""Words of UTF-8 texts as bytes: one translate and one split per text."""

from __future__ import annotations

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACES = {0x20, *range(0x09, 0x0E)}
#: Keeps 0-9, a-z (A-Z lower-cased) and every byte of a non-ASCII character.
_WORD = bytes(_LOWER[b] if b >= 0x80 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32
              for b in range(256))


def words_of(data: bytes) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters; A-Z lower-cased."""
    return data.translate(_WORD).split()


def spaced_words_of(data: bytes) -> list[bytes]:
    """Runs without space, tab, line feed, vertical tab, form feed or carriage return; A-Z lower-cased."""
    return data.translate(_LOWER).split()

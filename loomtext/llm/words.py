"""Words as the decontamination sees them."""

from __future__ import annotations

#: ASCII letters and digits and all bytes of other characters stay, the rest parts words.
_TABLE = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters of a whole text."""
    return (text or "").lower().encode("utf-8", "replace").translate(_TABLE).split()

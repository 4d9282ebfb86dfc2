"""Terms of texts, and the test of many terms against a bit filter.

A term is a maximal run of ASCII letters, ASCII digits and bytes of other characters;
A-Z count as a-z. Texts come as UTF-8 bytes (cast to binary in Spark), so that one
byte table and ``split`` do the work.
"""

from __future__ import annotations

from collections.abc import Iterator

from .common import by_value, passes

by_value(__name__)


def _table() -> bytes:
    inside = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
    return bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in inside else 0x20 for c in range(256))


_TABLE = _table()


def term_lists(data: bytes, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text in order, those of about ``most`` bytes at a time."""
    data = data.translate(_TABLE)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + most) if len(data) - at > most else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def digest(term: bytes) -> int:
    """The value of Spark's ``xxhash64`` for the term as a string, without a sign."""
    import xxhash

    return xxhash.xxh64_intdigest(term, 42)


class Sieve:
    """Which terms may be in a bit filter of ``xxhash64`` values; remembers about ``most`` bytes of answers."""

    def __init__(self, held, form=None, most: int = 16 << 20):
        self.held, self.form, self.most = held, form, most
        self.seen: set[bytes] = set()
        self.yes: dict[bytes, bytes] = {}
        self.size = 0

    def look(self, terms: set[bytes]) -> dict[bytes, bytes]:
        """Dictionary that has all ``terms`` whose form passes, with that form."""
        import numpy as np

        if self.size > self.most:
            self.seen, self.yes, self.size = set(), {}, 0
        fresh = list(terms - self.seen)
        if fresh:
            forms = list(map(self.form, fresh)) if self.form else fresh
            ok = passes(self.held, np.fromiter(map(digest, forms), np.uint64, len(forms)))
            for k in np.flatnonzero(ok).tolist():
                self.yes[fresh[k]] = forms[k]
            self.seen.update(fresh)
            self.size += sum(map(len, fresh)) + 80 * len(fresh)
        return self.yes

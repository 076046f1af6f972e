"""Statistics of one document, each computed when first asked for."""

from __future__ import annotations

from functools import cached_property

import numpy as np

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\v\f\r"
_UPPER, _LOWER, _DIGITS = (bytes(range(a, b + 1)) for a, b in ((65, 90), (97, 122), (48, 57)))
_ASCII = bytes(range(128))
_ENDS = (b".", b"!", b"?", b'"', b":", b";")


class Document:
    """A text as UTF-8 bytes (``None`` counts as no text). Words are runs of bytes other than ASCII white space."""

    def __init__(self, text: bytes | None):
        self.text = text or b""

    def _count(self, chars: bytes) -> int:
        return len(self.text) - len(self.text.translate(None, chars))

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text.translate(None, WHITE).decode("utf-8", "replace"))

    @cached_property
    def n_symbols(self) -> int:
        return self._count(SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines that hold a word."""
        return [x for x in self.text.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def word_ids(self) -> tuple[np.ndarray, int]:
        index = {w: i for i, w in enumerate(dict.fromkeys(self.words))}
        return np.fromiter(map(index.__getitem__, self.words), np.int64, self.n_words), len(index)

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that lie in a three-word window which the text has at least twice."""
        n = self.n_words
        if n < 4:
            return 0
        ids, v = self.word_ids
        if v < 1 << 20:
            key = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
        else:  # three ids no longer fit 63 bits: number the pairs first
            pair = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)[1]
            key = pair[:-1] * v + ids[2:]
        ordered = np.sort(key)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            return 0
        hit = np.isin(key, twice)
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= hit
        return int(covered.sum())

    @cached_property
    def n_upper(self) -> int:
        return self._count(_UPPER)

    @cached_property
    def n_lower(self) -> int:
        return self._count(_LOWER)

    @cached_property
    def n_digits(self) -> int:
        return self._count(_DIGITS)

    @cached_property
    def n_marks(self) -> int:
        """Code points past ASCII."""
        return 0 if self.text.isascii() else len(self.text.translate(None, _ASCII).decode("utf-8", "replace"))

    @cached_property
    def top_word(self) -> int:
        """How often the commonest word occurs."""
        return int(np.bincount(self.word_ids[0]).max()) if self.words else 0

    def vector(self) -> list[float]:
        """Statistics that a quality model may look at; all are ratios or logarithms, 0 for an empty text."""
        n, chars, lines = max(1, self.n_words), max(1, self.word_chars), max(1, len(self.lines))
        return [
            float(np.log1p(self.n_words)),
            self.word_chars / n,
            self.n_symbols / n,
            self.n_dup_lines / lines,
            self.n_repeat_words / n,
            self.word_ids[1] / n if self.words else 0.0,
            self.top_word / n,
            self.n_upper / chars,
            self.n_digits / chars,
            self.n_lower / chars,
            self.n_marks / chars,
            self._count(b".,;:!?") / n,
            self._count(b"|") / n,
            self._count(b"!") / n,
            float(np.log1p(self.n_words / lines)),
            sum(x.rstrip().endswith(_ENDS) for x in self.lines) / lines,
            sum(len(w) <= 3 for w in self.words) / n,
            float(np.log1p(max(map(len, self.words), default=0))),
        ]


FEATURES = len(Document(None).vector())

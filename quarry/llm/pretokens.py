"""Splitting texts at spaces where byte-level BPE never joins, so that each
distinct piece is tokenised once per worker.

A space that follows a non-blank, or that a non-blank follows, always starts a
new match of the split pattern (`` ?\\p{L}+ ...|\\s+(?!\\S)|\\s+``).  Texts with a
space between two blanks, or a blank run at their end, take the plain path.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

_UNSAFE = re.compile(r"(?:\s|\A) (?:\s|\Z)")
#: A space before another kind of blank: only then the pattern above is needed.
_PAIRS = [" " + chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) != " "]


def is_plain(text: str) -> bool:
    """Whether every space of the text starts a new match."""
    if "  " in text or text[0] == " " or text[-1] == " ":
        return False
    return not any(p in text for p in _PAIRS) or _UNSAFE.search(text) is None


class PieceCache:
    """``encode(piece) -> bytes`` remembered in two generations of about
    ``limit`` pieces; a full one replaces the older, whose pieces come back when
    they are met again.  So a worker's memory is bounded."""

    def __init__(self, encode_many: Callable[[list[str]], Iterable[bytes]], limit: int = 600_000, whole: tuple[str, ...] = ()):
        self.encode_many = encode_many
        self.limit = limit
        self.whole = whole  # texts with one of these go through undivided
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode_new(self, words: Iterable[str]) -> dict[str, bytes]:
        """Codes of pieces after a space.  A full stop or comma after a letter
        is a match of its own, so such a piece is its word and the mark."""
        back = {w: self.older[w] for w in words if w in self.older} if self.older else {}
        words = [w for w in words if w not in back]
        marked = [w for w in words if w[-1:] in (".", ",") and w[-2:-1].isalpha()]
        bare = set(words).difference(marked).union(w[:-1] for w in marked)
        codes = {b: self.known[b] for b in bare if b in self.known}
        bare = list(bare.difference(codes))
        codes.update(zip(bare, self.encode_many([" " + b for b in bare]), strict=True))
        mark = dict(zip(".,", self.encode_many([".", ","]), strict=True))
        codes.update([(w, codes[w[:-1]] + mark[w[-1]]) for w in marked])
        codes.update(back)
        return codes

    def encode(self, texts: list[str]) -> list[bytes]:
        """Encoded ids of every text, as bytes, in order.  Pieces that are not
        known yet are encoded together, once for all texts."""
        if len(self.known) > self.limit:
            self.known, self.older = {}, self.known
        get = self.known.get
        parts: list[list] = []
        heads: list[str] = []
        gaps: list[tuple[list, list[str], list[int]]] = []
        new: dict[str, bytes | None] = {}
        for text in texts:
            if not text or not is_plain(text) or any(w in text for w in self.whole):
                parts.append([])
                heads.append(text or "")
                continue
            first, *rest = text.split(" ")
            got = list(map(get, rest))
            if None in got:
                holes = [i for i, code in enumerate(got) if code is None]
                new.update(dict.fromkeys([rest[i] for i in holes]))
                gaps.append((got, rest, holes))
            heads.append(first)
            parts.append(got)
        if new:
            codes = self._encode_new(new)
            self.known.update(codes)
            for got, rest, holes in gaps:
                for i in holes:
                    got[i] = codes[rest[i]]
        return [h + b"".join(got) for h, got in zip(self.encode_many(heads), parts, strict=True)]

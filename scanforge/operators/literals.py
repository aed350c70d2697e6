"""Many literals looked up in many lines at once, on Arrow's own bytes.

Each literal is filed under the first three bytes of one of its grams. A block
of text gives the code of every three neighbouring bytes; a table tells which
of them are filed, and the bytes around the place decide. Memory is bounded by
Arrow's batch and the block, not by the number of lines or of their hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: bytes of text looked at together, and (place, literal) pairs verified together
BLOCK, PAIRS = 1 << 20, 1 << 20
#: Bytes of a lower-cased line that stood for an ASCII word letter before it was lower-cased. (i, k and s may come from U+0130, U+212A and U+017F.)
SURE_WORD = np.isin(np.arange(256), [*b"0123456789abcdefghjlmnopqrtuvwxyz_"])


def distinct(keys: list[np.ndarray]) -> np.ndarray:
    """Ascending, each once (np.unique hashes, which takes many times as long)."""
    every = np.concatenate([np.empty(0, np.int64), *keys])
    every.sort()
    return every[np.flatnonzero(np.diff(every, prepend=-1))]


class Literals:
    """Looks for ``entries``: (literal, gram of it, owner, apart).

    Owners are numbers from 0, ``owners`` of them; a line has an owner if it holds one of its literals. A literal that
    stands ``apart`` does not count next to a byte of ``SURE_WORD``."""

    def __init__(self, entries: list[tuple[str, str, int, bool]], owners: int):
        rows = []
        for text, gram, owner, apart in entries:
            raw, before = text.encode(), len(text[:text.index(gram)].encode())
            rows.append((int.from_bytes(raw[before:before + 3], "little"), before, raw, owner, apart))
        rows.sort()
        self.owners = owners
        self.before = np.array([r[1] for r in rows], np.int64)
        self.size = np.array([len(r[2]) for r in rows], np.int64)
        self.owner = np.array([r[3] for r in rows], np.int64)
        self.apart = np.array([r[4] for r in rows], bool)
        # a literal is compared in words of eight bytes; of the last one, those that it has. Three bytes are their code.
        self.n_words = np.where(self.size > 3, (self.size + 7) // 8, 0)
        self.at = np.cumsum(self.n_words) - self.n_words
        long = [r[2] for r in rows if len(r[2]) > 3]
        self.words = np.frombuffer(b"".join(x + bytes(-len(x) % 8) for x in long), "<u8")
        self.masks = np.frombuffer(b"".join(b"\xff" * len(x) + bytes(-len(x) % 8) for x in long), "<u8")
        self.codes, self.first, self.many = np.unique(np.array([r[0] for r in rows], np.int64), return_index=True, return_counts=True)
        self.slot = None

    def __getstate__(self) -> dict:
        return vars(self) | {"slot": None}  # made by each task: 64 MB

    def _slots(self) -> np.ndarray:
        """For each code, 1 + its position among those that are filed, or 0."""
        if self.slot is None:
            self.slot = np.zeros(1 << 24, np.int32)  # of its pages only those of codes that occur are touched
            self.slot[self.codes] = np.arange(1, len(self.codes) + 1)
        return self.slot

    def found(self, lines: pa.Array) -> Iterator[np.ndarray]:
        """Keys (line * ``owners`` + owner) of the owners that the lines have: each once, ascending over all the arrays given out."""
        _, ends, data = lines.buffers()
        if not len(lines) or data is None:
            return
        ends = np.frombuffer(ends, np.int64 if pa.types.is_large_string(lines.type) else np.int32)[lines.offset:lines.offset + len(lines) + 1].astype(np.int64)
        data = np.concatenate([np.frombuffer(data, np.uint8)[ends[0]:ends[-1]], np.zeros(8, np.uint8)])
        ends -= ends[0]
        line = 0
        while line < len(lines):
            after = max(line + 1, int(np.searchsorted(ends, ends[line] + BLOCK, "right")) - 1)
            yield distinct([k for at in range(ends[line], ends[after], BLOCK) for k in self._block(data, ends, at, min(at + BLOCK, ends[after] - 2))])
            line = after

    def _block(self, data: np.ndarray, ends: np.ndarray, low: int, high: int) -> Iterator[np.ndarray]:
        """Keys of literals whose gram begins at a byte from ``low`` to ``high``."""
        if high <= low:
            return
        text = data[low:high + 2].astype(np.int32)
        slots = self._slots()[text[:-2] | text[1:-1] << 8 | text[2:] << 16]
        places = np.flatnonzero(slots)
        slots = slots[places] - 1
        places += low
        first, last = np.searchsorted(ends, low, "right") - 1, np.searchsorted(ends, high)
        line = np.repeat(np.arange(first, last), np.diff(np.searchsorted(places, ends[first:last + 1])))
        many = self.many[slots]
        upto = np.cumsum(many)
        a = 0
        while a < len(places):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
            n = many[a:b]
            which = np.repeat(self.first[slots[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield self._verified(data, ends, np.repeat(line[a:b], n), np.repeat(places[a:b], n) - self.before[which], which)
            a = b

    def _verified(self, data: np.ndarray, ends: np.ndarray, line: np.ndarray, start: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Of places where literals would begin (their gram's first three bytes are there), the keys of those that stand there."""
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # the eight bytes from each place on
        done, word = [], 0
        while len(which):
            whole = self.n_words[which] == word
            if whole.any():
                done.append((line[whole], start[whole], which[whole]))
            at = self.at[which] + word
            at[whole] = 0
            place = np.clip(start + 8 * word, 0, len(eight) - 1)  # outside of the line, as found below
            same = np.flatnonzero(~whole & (eight[place] & self.masks[at] == self.words[at])) if len(self.words) else []
            line, start, which, word = line[same], start[same], which[same], word + 1
        keys = []
        for line, start, which in done:
            size = self.size[which]
            ok = (start >= ends[line]) & (start + size <= ends[line + 1])
            if self.apart.any():
                left = (start > ends[line]) & SURE_WORD[data[np.maximum(start - 1, 0)]]
                right = (start + size < ends[line + 1]) & SURE_WORD[data[np.minimum(start + size, len(data) - 1)]]
                ok &= ~(self.apart[which] & (left | right))
            keys.append(line[ok] * self.owners + self.owner[which[ok]])
        return distinct(keys)

    def lists(self, lines: pa.Array) -> pa.Array:
        """The owners of each line, ascending."""
        keys = distinct([*self.found(lines)])
        ends = np.searchsorted(keys, np.arange(len(lines) + 1) * self.owners)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys % self.owners, pa.int32()))

    def counts(self, lines: pa.Array) -> np.ndarray:
        """In how many lines each owner occurs."""
        total = np.zeros(self.owners, np.int64)
        for keys in self.found(lines):
            total += np.bincount(keys % self.owners, minlength=self.owners)
        return total

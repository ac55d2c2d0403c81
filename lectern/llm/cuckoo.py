"""A cuckoo filter over 128-bit keys in numpy: four slots a bucket, 16-bit fingerprints, an exact stash for what doesn't fit."""

from __future__ import annotations

import numpy as np

SLOTS = 4
KICKS = 200
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _prints(h2: np.ndarray) -> np.ndarray:
    """Fingerprints 1 to 65535; 0 marks an empty slot."""
    return ((h2.view(np.uint64) >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)


def _other(bucket: np.ndarray, prints: np.ndarray, mask: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (bucket ^ ((prints.astype(np.uint64) * _MIX) >> np.uint64(32)).astype(np.int64)) & mask


class CuckooFilter:
    """Keys are pairs of int64 arrays (h1, h2). No false negatives; deletion takes out one copy of a key that was put in."""

    def __init__(self, n_buckets: int = 64, slots: np.ndarray | None = None, stash: set | None = None):
        self.n_buckets = n_buckets
        self.slots = np.zeros((n_buckets, SLOTS), np.uint16) if slots is None else slots
        self.stash = stash or set()

    @classmethod
    def sized_for(cls, n_keys: int) -> CuckooFilter:
        return cls(1 << max(6, int(np.ceil(np.log2(max(1, n_keys) / (SLOTS * 0.8))))))

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = self.n_buckets - 1
        prints = _prints(h2)
        first = h1 & mask
        return prints, first, _other(first, prints, mask)

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> None:
        prints, first, second = self._places(h1, h2)
        mask, slots = self.n_buckets - 1, self.slots
        step = [int(x) for x in ((np.arange(65536, dtype=np.uint64) * _MIX) >> np.uint64(32)) & np.uint64(mask)] if len(prints) > 4096 else None
        for k, (p, a, b) in enumerate(zip(prints.tolist(), first.tolist(), second.tolist(), strict=True)):
            for at in (a, b):
                row = slots[at]
                free = (row == 0).argmax()
                if row[free] == 0:
                    row[free] = p
                    break
            else:
                self._kick(p, b, (int(h1[k]), int(h2[k])), step)

    def _kick(self, p: int, at: int, key: tuple[int, int], step: list[int] | None) -> None:
        mask, slots, moved = self.n_buckets - 1, self.slots, []
        for turn in range(KICKS):
            place = (at, (p + turn) % SLOTS)
            moved.append((place, int(slots[place])))
            slots[place], p = p, int(slots[place])
            at = (at ^ (step[p] if step else (p * int(_MIX) % 2**64) >> 32)) & mask
            free = (slots[at] == 0).argmax()
            if slots[at, free] == 0:
                slots[at, free] = p
                return
        for place, old in reversed(moved):  # undo, and hold the key itself in the stash
            slots[place] = old
        self.stash.add(key)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(h1, h2)
        want = prints[:, None]
        found = (self.slots[first] == want).any(axis=1) | (self.slots[second] == want).any(axis=1)
        if self.stash:
            found |= np.fromiter(((a, b) in self.stash for a, b in zip(h1.tolist(), h2.tolist(), strict=True)), bool, len(h1))
        return found

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        prints, first, second = self._places(h1, h2)
        for k, (p, a, b) in enumerate(zip(prints.tolist(), first.tolist(), second.tolist(), strict=True)):
            if (key := (int(h1[k]), int(h2[k]))) in self.stash:
                self.stash.discard(key)
                continue
            for at in (a, b):
                held = (self.slots[at] == p).argmax()
                if self.slots[at, held] == p:
                    self.slots[at, held] = 0
                    break

    def to_bytes(self) -> tuple[int, bytes, bytes]:
        stash = np.array(sorted(self.stash), np.int64).reshape(-1, 2)
        return self.n_buckets, self.slots.tobytes(), stash.tobytes()

    @classmethod
    def from_bytes(cls, n_buckets: int, slots: bytes, stash: bytes) -> CuckooFilter:
        held = np.frombuffer(stash, np.int64).reshape(-1, 2)
        return cls(n_buckets, np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).copy(), {(int(a), int(b)) for a, b in held})

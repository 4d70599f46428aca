"""A run-length index of short texts: run-compressed Burrows-Wheeler transform with sampled run ends.

Stored are, for each run of the transform, its first row, its character, where its first row goes by the last-to-first
mapping, and the text position at its first and last row; and the blocks of rows whose suffixes share their first
`depth` characters, each with the smallest owner of its texts. Matching statistics are streamed from a text's end to
its start: while the transform's character at the current row is the text's, the row moves by the mapping and the
match grows by one; else it jumps to the nearer end of a neighbouring run of that character, whose sample tells how
much still matches. Where a match is `depth` long, the row's block names the smallest owner of that string.

All texts take their steps together, so a step is a few numpy calls.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = 1
#: Characters of 9 bits in a number of 64.
PACKED = 7


def ranks(text: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, inverse, each position's first PACKED characters as a number) by prefix doubling from eight characters on; suffixes end with the first separator, and
    equal ones are in order of position."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, text.dtype)])
    key = np.zeros(n, np.uint64)
    alive = np.ones(n, bool)
    for j in range(PACKED):
        c = padded[j : j + n].astype(np.uint64)
        key = key << np.uint64(9) | np.where(alive, c, 0).astype(np.uint64)
        alive &= c != SEPARATOR
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    rank = np.empty(n, np.int64)
    first = np.flatnonzero(new)
    rank[order] = np.repeat(first, np.diff(np.concatenate([first, [n]])))
    # Of each position, the characters left to the separator inclusive.
    ends = np.flatnonzero(text == SEPARATOR)
    left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n) + 1
    h = PACKED
    while h < longest + 1:
        # Rows that still share their rank with another.
        size = np.diff(np.concatenate([first, [n]]))
        tied = np.repeat(size > 1, size)
        rows = np.flatnonzero(tied)
        if not len(rows):
            break
        at = order[rows]
        more = np.where(left[at] > h, rank[np.minimum(at + h, n - 1)] + 1, 0)
        pair = rank[at].astype(np.uint64) << np.uint64(32) | more.astype(np.uint64)
        again = np.argsort(pair, kind="stable")
        order[rows] = at[again]
        p = pair[again]
        fresh = np.concatenate([[True], p[1:] != p[:-1]])
        new[rows] = fresh
        first = np.flatnonzero(new)
        full = np.repeat(first, np.diff(np.concatenate([first, [n]])))
        rank[order[rows]] = full[rows]
        h *= 2
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    return order, inverse, key


class RunLengthIndex:
    def __init__(self, texts: np.ndarray, starts: np.ndarray, owners: np.ndarray, depth: int):
        """texts: bytes end to end; starts: where each begins; owners: an integer for each."""
        sizes = np.diff(np.concatenate([starts, [len(texts)]]))
        n = len(texts) + len(starts)
        self.depth, self.begin, self.sizes = depth, starts + np.arange(len(starts)), sizes
        self.end = self.begin + sizes  # of the separators
        text = np.full(n, SEPARATOR, np.uint16)
        inside = np.ones(n, bool)
        inside[self.end] = False
        text[inside] = texts.astype(np.uint16) + 2
        order, inverse, packed = ranks(text, int(sizes.max(initial=0)))
        last = text[order - 1]
        last[order == 0] = 0
        self.run_start = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
        self.head = last[self.run_start]
        run_size = np.diff(np.concatenate([self.run_start, [n]]))
        self.run_of = np.repeat(np.arange(len(run_size), dtype=np.int32), run_size)  # of each row
        # Rows that begin with a smaller character, then rows of the same character in earlier runs.
        by_head = np.argsort(self.head, kind="stable")
        before = np.concatenate([[0], np.cumsum(run_size[by_head])[:-1]])
        self.to = np.empty(len(self.head), np.int64)
        self.to[by_head] = before
        self.sample_first, self.sample_last = order[self.run_start], order[self.run_start + run_size - 1]
        self.by_head, self.head_at = by_head, np.searchsorted(self.head[by_head], np.arange(259))
        self.ends = inverse[self.end]
        self.text = text
        # Blocks of rows that share their first depth characters.
        long = np.zeros(n + 1, bool)
        valid = np.zeros(n, bool)
        left = np.repeat(self.end, sizes + 1) - np.arange(n)
        valid[:] = left >= depth
        a, b = order[:-1], order[1:]
        both = np.flatnonzero(valid[a] & valid[b])
        same = np.ones(len(both), bool)
        x, y = a[both], b[both]
        what, steps = (text, range(depth)) if depth < PACKED else (packed, [*range(0, depth - PACKED, PACKED), depth - PACKED])
        for j in steps:
            some = np.flatnonzero(same)
            same[some] = what[x[some] + j] == what[y[some] + j]
        long[both[same] + 1] = True
        self.block_start = np.flatnonzero(~long[:n])
        owner = np.repeat(owners, sizes + 1)[order]
        self.block_owner = np.minimum.reduceat(owner, self.block_start) if n else owner
        self.block_of = np.cumsum(~long[:n], dtype=np.int32) - 1  # of each row

    def run(self, row: np.ndarray) -> np.ndarray:
        return self.run_of[row].astype(np.int64)

    def common(self, position: np.ndarray, other: np.ndarray, other_at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many characters from the text positions agree with other's from other_at, most at most."""
        length = np.zeros(len(position), np.int64)
        going = np.flatnonzero(most > 0)
        j = 0
        while len(going):
            p = position[going] + j
            good = (p < len(self.text)) & (self.text[np.minimum(p, len(self.text) - 1)] == other[other_at[going] + j])
            going = going[good]
            length[going] += 1
            j += 1
            going = going[most[going] > j]
        return length

    def jump(self, row: np.ndarray, run: np.ndarray, char: np.ndarray, other: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(run, row, length) of the better of the neighbouring run ends of char; run -1 if char is in no run."""
        low, high = self.head_at[char], self.head_at[char + 1]
        place = np.empty(len(row), np.int64)
        for c in np.unique(char):
            some = char == c
            place[some] = self.head_at[c] + np.searchsorted(self.by_head[self.head_at[c] : self.head_at[c + 1]], run[some])
        limit = len(self.by_head) - 1
        above, below = self.by_head[np.clip(place - 1, 0, limit)], self.by_head[np.clip(place, 0, limit)]
        up = np.where(place > low, self.common(self.sample_last[above], other, at, np.where(place > low, length, 0)), -1)
        down = np.where(place < high, self.common(self.sample_first[below], other, at, np.where(place < high, length, 0)), -1)
        next_start = np.concatenate([self.run_start, [len(self.text)]])
        to = np.where(up >= down, above, below)
        return np.where((up < 0) & (down < 0), -1, to), np.where(up >= down, next_start[above + 1] - 1, self.run_start[below]), np.maximum(up, down)

    def stream(self, texts: np.ndarray, starts: np.ndarray, rows: np.ndarray | None = None):
        """Matching statistics of texts, given as to the constructor. Yields, from the ends on, (texts' numbers,
        positions in them, match lengths, rows). rows: where to start, the index's own `ends` for its own texts."""
        sizes = np.diff(np.concatenate([starts, [len(texts)]]))
        order = np.argsort(-sizes, kind="stable")
        chars = texts.astype(np.uint16) + 2
        row = (np.zeros(len(starts), np.int64) if rows is None else rows.copy())[order]
        length = np.zeros(len(starts), np.int64)
        at = (starts + sizes)[order]
        sizes = sizes[order]
        for step in range(1, int(sizes.max(initial=0)) + 1):
            n = np.searchsorted(-sizes, -step, "right")
            row, length, at = row[:n], length[:n], at[:n] - 1
            char = chars[at]
            run = self.run(row)
            off = np.flatnonzero(self.head[run] != char)
            if len(off):
                to, where, kept = self.jump(row[off], run[off], char[off], chars, at[off] + 1, length[off])
                lost = to < 0
                run[off], row[off], length[off] = np.where(lost, 0, to), np.where(lost, 0, where), np.where(lost, -1, kept)
                row = np.where(length < 0, 0, self.to[run] + row - self.run_start[run])
            else:
                row = self.to[run] + row - self.run_start[run]
            length = length + 1
            yield order[:n], sizes[:n] - step, length, row

    def smallest_owner(self, row: np.ndarray) -> np.ndarray:
        return self.block_owner[self.block_of[row]]

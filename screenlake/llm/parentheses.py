"""A tree as balanced parentheses: one opens where a node starts in depth-first order and closes after its subtree.

The excess of a place is the number of parentheses still open there. ``find_close`` finds the first later
place with a smaller excess: in the node's own block, else in the next block whose least excess is small
enough, found by climbing and descending a tree of block minima. All nodes are looked up at once.
"""

from __future__ import annotations

import numpy as np

BLOCK = 64


class Parentheses:
    def __init__(self, opens: np.ndarray):
        """``opens``: true where a parenthesis opens, of one balanced sequence."""
        self.opens = opens
        self.at = np.flatnonzero(opens)
        self.excess = np.cumsum(np.where(opens, 1, -1), dtype=np.int32)
        self.rank = np.cumsum(opens, dtype=np.int64)
        pair = opens.copy()
        pair[:-1] &= ~opens[1:]
        self.pairs = np.cumsum(pair, dtype=np.int64)
        leaves = 1 << max(0, (-(-len(opens) // BLOCK) - 1).bit_length())
        padded = np.full(leaves * BLOCK, len(opens) + 1, dtype=np.int32)
        padded[: len(opens)] = self.excess
        self.blocks = padded.reshape(leaves, BLOCK)
        self.least = np.empty(2 * leaves, dtype=np.int32)  # node i has the children 2i and 2i + 1
        self.least[leaves:] = self.blocks.min(axis=1)
        level = leaves
        while level > 1:
            self.least[level // 2 : level] = self.least[level : 2 * level].reshape(-1, 2).min(axis=1)
            level //= 2
        self.leaves = leaves

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """The place that closes what opens at each of ``at``."""
        out = np.full(len(at), -1, dtype=np.int64)
        for k in range(0, len(at), 1 << 14):  # bounds the blocks looked at together
            part = at[k : k + (1 << 14)]
            out[k : k + len(part)] = self._close(part)
        return out

    def _close(self, at: np.ndarray) -> np.ndarray:
        target, block = self.excess[at] - 1, at // BLOCK
        found = self._first(block, at % BLOCK, target)
        far = np.flatnonzero(found < 0)
        node = block[far] + self.leaves
        up = np.ones(len(far), dtype=bool)
        while up.any():  # to the first right neighbour that is deep enough; the sequence is balanced, so there is one
            here = node[up]
            right = here + 1
            stop = (here % 2 == 0) & (self.least[right] <= target[far[up]])
            node[up] = np.where(stop, right, here // 2)
            up[np.flatnonzero(up)[stop]] = False
        while (down := node < self.leaves).any():
            left = 2 * node[down]
            node[down] = np.where(self.least[left] <= target[far[down]], left, left + 1)
        found[far] = self._first(node - self.leaves, np.full(len(far), -1), target[far])
        return found

    def _first(self, block: np.ndarray, after: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first place of the block behind ``after`` whose excess is at most the target, or -1."""
        hit = (self.blocks[block] <= target[:, None]) & (np.arange(BLOCK) > after[:, None])
        return np.where(hit.any(axis=1), block * BLOCK + hit.argmax(axis=1), -1)

    def subtrees(self) -> tuple[np.ndarray, np.ndarray]:
        """For each node in depth-first order: the node after its subtree, and the leaves in its subtree."""
        close = self.find_close(self.at)
        before = np.where(self.at > 0, self.pairs[self.at - 1], 0)
        return self.rank[close], self.pairs[close] - before

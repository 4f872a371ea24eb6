"""Canonical length-limited Huffman codes of token ids: code lengths by package-merge, numpy coding and table decoding."""

from __future__ import annotations

import numpy as np

#: Longest code, so that one table look-up of 2**LIMIT entries decodes a token; enough for 2**LIMIT different ids.
LIMIT = 18
#: Tokens of a block: a block can be decoded from its bit offset alone.
BLOCK = 256
#: Tokens that are coded at a time: arrays of that length stay in a core's cache.
AT_ONCE = 1 << 15


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits for each id (0: the id doesn't occur); ties go to the smaller id."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        at = np.argsort(both, kind="stable")
        levels.append(at < len(leaves))
        merged = both[at]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * len(leaves) - 2
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


class Codebook:
    """Canonical codes: ordered by (length, id), counted upwards."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.uint8)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        span = np.left_shift(1, LIMIT - self.lengths[order].astype(np.int64))
        first = np.concatenate([[0], np.cumsum(span)[:-1]]) if len(order) else np.zeros(0, np.int64)
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (first >> (LIMIT - self.lengths[order].astype(np.int64))).astype(np.uint64)
        self.symbol = np.zeros(1 << LIMIT, np.uint16)
        self.width = np.ones(1 << LIMIT, np.uint8)
        filled = int(span.sum()) if len(order) else 0
        self.symbol[:filled] = np.repeat(order, span)
        self.width[:filled] = np.repeat(self.lengths[order], span)

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> list[tuple[bytes, np.ndarray]]:
        """Sequences of these sizes (none empty), one behind another in ids -> for each its bits, filled to whole bytes,
        and the bit offset of each of its blocks. Each begins at a byte of its own."""
        first = np.cumsum(sizes) - sizes
        cuts = [*np.flatnonzero(np.diff(first // AT_ONCE, prepend=-1)).tolist(), len(sizes)]
        at = [*first.tolist(), len(ids)]
        return [x for i, j in zip(cuts, cuts[1:], strict=False) for x in self._encode(ids[at[i] : at[j]], sizes[i:j])]

    def _encode(self, ids: np.ndarray, sizes: np.ndarray) -> list[tuple[bytes, np.ndarray]]:
        width = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(width)
        last = np.cumsum(sizes)
        first = last - sizes
        bits = np.diff(ends[last - 1], prepend=0)
        byte_ends = np.cumsum((bits + 7) // 8)
        byte_starts = byte_ends - (bits + 7) // 8
        starts = ends - width + np.repeat(byte_starts * 8 - (ends - width)[first], sizes)
        word, shift = starts >> 6, 64 - (starts & 63) - width
        code = self.codes[ids]
        over = np.flatnonzero(shift < 0)
        spill = (-shift[over]).astype(np.uint64)
        shift[over] = 0
        high = code << shift.astype(np.uint64)
        high[over] = code[over] >> spill
        out = np.zeros(int(byte_ends[-1] >> 3) + 2, np.uint64)
        heads = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[heads]] = np.add.reduceat(high, heads)
        out[word[over] + 1] += code[over] << (np.uint64(64) - spill)
        packed = out.byteswap().tobytes()
        local = starts - np.repeat(byte_starts * 8, sizes)
        return [(packed[a:b], local[i:j:BLOCK].astype(np.uint32)) for a, b, i, j in zip(byte_starts.tolist(), byte_ends.tolist(), first.tolist(), last.tolist(), strict=True)]

    def decode(self, bits: bytes, offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ids of all blocks, one after another; blocks are independent and are decoded side by side."""
        if not len(offsets):
            return np.zeros(0, np.uint16)
        words = np.frombuffer(bits + b"\0" * (24 - len(bits) % 8), ">u8").astype(np.uint64)
        longest = int(sizes.max())
        out = np.zeros((longest, len(offsets)), np.uint16)
        order = np.argsort(-sizes, kind="stable")
        longer = len(sizes) - np.cumsum(np.bincount(sizes, minlength=longest))  # blocks with more than j tokens
        at = offsets[order].astype(np.int64)
        for j, n in enumerate(longer[:longest].tolist()):
            p = at[:n]
            w, s = p >> 6, (p & 63).view(np.uint64)
            window = (((words[w] << s) | ((words[w + 1] >> np.uint64(1)) >> (np.uint64(63) - s))) >> np.uint64(64 - LIMIT)).view(np.int64)
            out[j, :n] = self.symbol[window]
            p += self.width[window]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return out.T[back][np.arange(longest) < sizes[:, None]]

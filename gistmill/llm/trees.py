"""Context-tree weighting over bytes, in numpy: subtrees below contexts of three bytes, and the top of the tree.

A gram is a context of DEPTH bytes, the nearest first, and the byte that follows, as one integer. The following byte is
eight binary decisions, of which a context has 255 nodes (heap order). At each node of a context the Krichevsky-Trofimov
estimate of its own counts is mixed with the product of the weighted estimates of the contexts one byte longer, half and
half, at all depths; a longer context that has not met a decision abstains, and the shorter one's own estimate holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of the longest context, and of those below which subtrees are made apart.
DEPTH, TOP = 5, 3
#: The byte, in no UTF-8 text, that stands before a text and ends it.
END = 0xFF
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LEAST = 1e-9
#: Grams that are made at once.
_PIECE = 1 << 20


def gram_pieces(raw: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The grams of a run of texts, A-Z lower-cased: one for each byte and one for each text's end, in order, piece by piece."""
    texts = len(offsets) - 1
    if not texts:
        return
    first = offsets[:-1] + (np.arange(texts) + 1) * DEPTH + np.arange(texts)
    padded = np.full(len(raw) + texts * (DEPTH + 1), END, np.uint8)
    keep = np.ones(len(padded), bool)
    for back in range(1, DEPTH + 1):  # the bytes before a text
        keep[first - back] = False
    for a, b, at in zip(offsets[:-1].tolist(), offsets[1:].tolist(), first.tolist(), strict=True):
        padded[at : at + b - a] = _LOWER[raw[a:b]]
    for at in range(DEPTH, len(padded), _PIECE):
        end = min(at + _PIECE, len(padded))
        keys = padded[at:end].astype(np.uint64)
        for j in range(1, DEPTH + 1):
            keys |= padded[at - j : end - j].astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - j))
        yield keys[keep[at:end]]


def subtree_of(keys: np.ndarray) -> np.ndarray:
    """The TOP nearest bytes of the grams' contexts, by which grams are dealt."""
    return keys >> np.uint64(8 * (DEPTH - TOP + 1))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - shift


_HALVES, _ONES = (_log_gamma(np.arange(1 << 14) + x) for x in (0.5, 1.0))


def _tabled(counts: np.ndarray, plus: float, table: np.ndarray) -> np.ndarray:
    out = table[np.minimum(counts, len(table) - 1)]
    large = counts >= len(table)
    if large.any():
        out[large] = _log_gamma(counts[large] + plus)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov estimate of sequences with these counts."""
    return _tabled(zeros, 0.5, _HALVES) + _tabled(ones, 0.5, _HALVES) - _tabled(zeros + ones, 1.0, _ONES) - np.log(np.pi)


def _mix(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log of the weighted estimate, the own estimate's share of it, and the own estimate of a one."""
    own = log_kt(zeros, ones)
    one = (ones + 0.5) / (zeros + ones + 1)
    if below is None:
        return own, np.ones(len(own)), one
    weighted = np.logaddexp(own, below) - np.log(2)
    return weighted, np.exp(own - np.log(2) - weighted), one


class Subtrees:
    """Whole subtrees, from their sorted distinct grams and these grams' counts in training (0 for others).

    ones: for each gram and decision, the probability of a one as contexts of TOP bytes and more mix it; NaN where none has
    met the decision. roots: the nodes of each subtree's root that training has met.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        levels = [(keys, counts, None)]  # of each depth: (context and byte), their counts, and places among those one byte shorter
        for _ in range(DEPTH - TOP):
            longer, n, _ = levels[-1]
            short, at = np.unique(longer >> np.uint64(16) << np.uint64(8) | longer & np.uint64(255), return_inverse=True)
            levels[-1] = longer, n, at
            levels.append((short, np.bincount(at, weights=n, minlength=len(short)).astype(np.int64), None))
        self.ones = np.empty((len(keys), 8))
        nodes, roots = [], []
        for k in range(8):
            below, mixed = None, []
            for keys_, n, at in levels:
                group = keys_ >> np.uint64(8 - k)
                fresh = np.append(True, group[1:] != group[:-1])
                start, entry = np.flatnonzero(fresh), np.cumsum(fresh) - 1
                one = np.where(keys_ >> np.uint64(7 - k) & np.uint64(1), n, 0)
                total, ones = np.add.reduceat(n, start), np.add.reduceat(one, start)
                if below is not None:  # of the level before: weighted estimates of its entries, summed over an entry here
                    weighted, first, up = below
                    sums = np.bincount(entry[up[first]], weights=weighted, minlength=len(start))
                else:
                    sums = None
                weighted, share, probability = _mix(total - ones, ones, sums)
                mixed.append((entry, total, share, probability))
                below = weighted, start, at
            # from the subtree's root down to the grams; places of each gram at the depths above
            nodes.append((levels[-1][0][start], k, total - ones, ones, weighted))
            place = np.arange(len(keys))
            found = np.full(len(keys), np.nan)
            places = [place]
            for _, _, at in levels[:-1]:
                places.append(at[places[-1]])
            for (entry, total, share, probability), at in zip(mixed, places, strict=True):
                e = entry[at]
                known = np.isnan(found)
                p = np.where(known, probability[e], share[e] * probability[e] + (1 - share[e]) * found)
                found = np.where(total[e] > 0, p, found)
            self.ones[:, k] = found
        for contexts, k, zeros, ones, weighted in nodes:
            met = zeros + ones > 0
            symbol = (contexts[met] & np.uint64(255)).astype(np.int64)
            roots.append((contexts[met] >> np.uint64(8), (1 << k) - 1 + (symbol >> (8 - k)), zeros[met], ones[met], weighted[met]))
        self.roots = tuple(np.concatenate(x) for x in zip(*roots, strict=True))


class Top:
    """Contexts of fewer than TOP bytes, at most 65,793: what they add to the mixture of each longer one.

    parent: for each root node of a subtree, or sums of such nodes, its context's TOP - 1 nearest bytes; node, zeros, ones and
    weighted as in Subtrees.roots. A probability p of a longer context becomes plus + times * p, and alone where it abstains.
    """

    def __init__(self, parent: np.ndarray, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weighted: np.ndarray):
        contexts, row = np.unique(parent.astype(np.int64), return_inverse=True)
        zero, one, below = (np.bincount(row * 255 + node, weights=x, minlength=len(contexts) * 255).reshape(-1, 255) for x in (zeros, ones, weighted))
        levels = []  # from two bytes to none: contexts, total counts, shares, own estimates, places among those one byte shorter
        for depth in range(TOP - 1, -1, -1):
            w, share, probability = (x.reshape(-1, 255) for x in _mix(zero.ravel().astype(np.int64), one.ravel().astype(np.int64), below.ravel()))
            short, at = np.unique(contexts >> 8, return_inverse=True)
            levels.append((contexts, zero + one, share, probability, at))
            if depth:
                contexts = short
                zero, one, below = (self._added(x, at, len(short)) for x in (zero, one, np.where(zero + one > 0, w, 0)))
        plus, times = np.zeros((1, 255)), np.ones((1, 255))
        alone = np.full((1, 255), 0.5)
        index = np.zeros(1, np.int64)  # of every context of so many bytes, its row; those not met take their suffix's
        rows = [(plus, times, alone)]
        for depth, (contexts, total, share, probability, at) in enumerate(reversed(levels)):
            above = index[contexts >> 8] if depth else np.zeros(len(contexts), np.int64)
            plus, times, alone = (np.concatenate([x[i] for x in rows]) for i in range(3))
            plus, times, alone = plus[above], times[above], alone[above]
            met = total > 0
            own = np.where(met, plus + times * probability, alone)
            plus, times = np.where(met, plus + times * share * probability, plus), np.where(met, times * (1 - share), times)
            size = sum(len(x[0]) for x in rows)
            rows.append((plus, times, own))
            wider = np.repeat(index, 256) if depth else np.zeros(1, np.int64)
            wider[contexts] = size + np.arange(len(contexts))
            index = wider
        self.index = index.astype(np.int32)
        self.plus, self.times, self.alone = (np.concatenate([x[i] for x in rows]).astype(np.float32) for i in range(3))

    @staticmethod
    def _added(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, x.shape[1]))
        np.add.at(out, at, x)
        return out

    def log10(self, keys: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's byte in its context, from its Subtrees.ones."""
        row = self.index[(keys >> np.uint64(8 * (DEPTH - TOP + 2))).astype(np.int64)]
        symbol = (keys & np.uint64(255)).astype(np.int64)
        out = np.zeros(len(keys))
        for k in range(8):
            node = (1 << k) - 1 + (symbol >> (8 - k))
            p = ones[:, k].astype(float)
            p = np.where(np.isnan(p), self.alone[row, node], self.plus[row, node] + self.times[row, node] * p)
            p = np.clip(p, _LEAST, 1 - _LEAST)
            out += np.log10(np.where(symbol >> (7 - k) & 1, p, 1 - p))
        return out


# ---- tables -------------------------------------------------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """64-bit values as differences whose bytes lie plane by plane: sorted or small ones compress well."""
    v = values.view(np.uint64)
    return np.append(v[:1], v[1:] - v[:-1]).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes, kind: type = np.uint64) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64).view(kind)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of several (keys, counts), and their counts' sums."""
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[start], np.add.reduceat(counts, start) if len(start) else counts


class Lookup:
    """Values of 64-bit keys, found by hash."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(1, int(len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        self.keys, self.values = np.append(keys[order], np.uint64(0)), np.append(values[order], values.dtype.type(0))
        self.start = np.searchsorted(slot[order], np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key; every one must be there."""
        at = self.start[self._slot(keys).astype(np.int64)].astype(np.int64)
        pending = np.flatnonzero(self.keys[at] != keys)
        while len(pending):
            at[pending] += 1
            pending = pending[self.keys[at[pending]] != keys[pending]]
        return self.values[at]

"""Online logistic mixing of hashed-context bit predictors over a Huffman code of symbols.

A symbol is coded bit by bit on its way through the code's tree. Each bit is predicted by the node's own counts and by
counts of (context, node) in hashed slots; the log odds are weighted by a set of weights that the slots' experience
chooses, and the weights move after each block that they have coded."""
import numpy as np
import pandas as pd

EXPERIENCE = (1, 3, 16)             # bits seen in a slot at which it counts as more experienced
SLICE = 2048                        # slots of a table that travel as one row
TOP = 14.0                          # largest log odds of a prediction
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(a: np.ndarray, b) -> np.ndarray:
    """One hash of two arrays of whole numbers."""
    x = (np.asarray(a).astype(np.uint64) + np.uint64(1)) * _A + np.asarray(b).astype(np.uint64) * _B
    return x ^ (x >> np.uint64(29))


class Code:
    """Huffman code of symbols with the given counts (at least two symbols, counts over 0)."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        order = np.argsort(counts, kind="stable")
        weight = [*counts[order].tolist(), *[0] * (n - 1)]
        parent, side = np.zeros(2 * n - 1, dtype=np.int64), np.zeros(2 * n - 1, dtype=np.int8)
        leaf, inner, odds = 0, n, np.zeros(n - 1)
        for k in range(n, 2 * n - 1):
            pair = []
            for _ in range(2):
                if inner >= k or leaf < n and weight[leaf] <= weight[inner]:
                    pair.append(leaf)
                    leaf += 1
                else:
                    pair.append(inner)
                    inner += 1
            a, b = pair
            weight[k] = weight[a] + weight[b]
            parent[a] = parent[b] = k
            side[b] = 1
            odds[k - n] = np.log((weight[b] + 0.4) / (weight[a] + 0.4))
        at = np.empty(n, dtype=np.int64)
        at[order] = np.arange(n)
        nodes, sides = [], []
        while (live := at < 2 * n - 2).any():
            nodes.append(np.where(live, parent[at] - n, -1))
            sides.append(side[at])
            at = np.where(live, parent[at], at)
        path, turn = np.stack(nodes[::-1], axis=1), np.stack(sides[::-1], axis=1)
        used = path >= 0
        self.length = used.sum(axis=1)
        self.start = np.cumsum(self.length) - self.length
        self.node, self.bit = path[used].astype(np.int32), turn[used]
        self.odds = odds.astype(np.float32)

    def bits(self, x: np.ndarray):
        """For each bit of the symbols x: place of its symbol, node, bit."""
        size = self.length[x]
        ends = np.cumsum(size)
        who = np.repeat(np.arange(len(x)), size)
        at = np.arange(len(who)) + np.repeat(self.start[x] - (ends - size), size)
        return who, self.node[at], self.bit[at]


def places(ctx: list, who: np.ndarray, node: np.ndarray, bits: int, nodes: int) -> list:
    """Slot of each bit in each predictor's table. Contexts are hashes; small numbers in 32 bits have slots of their own."""
    m = node.astype(np.uint64) * _B
    return [(((c[who] ^ m) * _A) >> np.uint64(64 - bits)).astype(np.int64) if c.dtype == np.uint64 else c[who] * np.int64(nodes) + node for c in ctx]


def experience(n: np.ndarray) -> np.ndarray:
    """How much a slot has seen, 0 to 3."""
    return sum((n >= k).view(np.int8) for k in EXPERIENCE)


def gates(levels: list) -> np.ndarray:
    g = levels[0]
    for v in levels[1:]:
        g = g * np.int8(4) + v
    return g.astype(np.int64)


def first_weights(predictors: int) -> np.ndarray:
    """A column for each gate: the node's own counts first, then each predictor."""
    w = np.full((predictors + 1, 4 ** predictors), 0.15, dtype=np.float32)
    w[0] = 0.6
    return w


def mix(st: list, bit: np.ndarray, w: np.ndarray, at: np.ndarray, rate: float):
    """Natural log of each bit's probability; moves the columns `at` of w by what the block has shown."""
    z = w[0].take(at) * st[0]
    for k in range(1, len(st)):
        z += w[k].take(at) * st[k]
    np.clip(z, -TOP, TOP, out=z)
    side = 2 * bit.astype(np.float32) - 1
    wrong = np.exp(-z * side)                # odds of the other bit
    lp = -np.log(1 + wrong)
    err = side * (wrong / (1 + wrong))
    pace = rate / np.maximum(1, np.bincount(at, minlength=w.shape[1]) / 64)
    for k, s in enumerate(st):
        w[k] += pace * np.bincount(at, err * s, minlength=w.shape[1])
    return lp


class Learner:
    """Counts and weights learned in one pass: each block is predicted by what came before it, then learned."""

    def __init__(self, code: Code, predictors: int, bits: int, rate: float = 0.02):
        self.code, self.bits, self.rate, self.n = code, bits, rate, 0
        self.counts = np.zeros((predictors, 1 << bits), dtype=np.uint64)   # ones in the upper half, zeros in the lower
        self.w = first_weights(predictors)

    def learn(self, x: np.ndarray, ctx: list) -> None:
        who, node, bit = self.code.bits(x)
        where = places(ctx, who, node, self.bits, len(self.code.odds))
        st, levels, one = [self.code.odds[node]], [], bit.astype(np.uint64) * np.uint64((1 << 32) - 1) + np.uint64(1)
        for c, s in zip(self.counts, where):
            got = c[s].view(np.uint32)
            n0, n1 = got[0::2].astype(np.float32), got[1::2].astype(np.float32)
            st.append(np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4))))
            levels.append(experience(n0 + n1))
        mix(st, bit, self.w, gates(levels), self.rate)
        for c, s in zip(self.counts, where):
            np.add.at(c, s, one)
        self.n += len(bit)

    def rows(self) -> pd.DataFrame:
        """slice, data: sums of the table's slices that are not all zero; after the last slice the weights times the bits
        they come from, a row for each gate."""
        out = []
        parts = self.counts.reshape(-1, SLICE)
        for i in np.flatnonzero(parts.any(axis=1)).tolist():
            out.append((i, parts[i].view(np.uint32).astype(np.float32).tobytes()))
        if self.n:
            for g, row in enumerate(self.w.T):
                out.append((len(parts) + g, (np.append(row, 1) * np.float64(self.n)).astype(np.float32).tobytes()))
        return pd.DataFrame(out, columns=["slice", "data"])


def add_up(it):
    """Sums of each slice's rows that a task holds."""
    total: dict = {}
    for pdf in it:
        for i, d in zip(pdf["slice"], pdf["data"]):
            v = np.frombuffer(d, dtype=np.float32)
            if i in total:
                total[i] += v
            else:
                total[i] = v.astype(np.float64) if len(v) < SLICE else v.copy()
    yield pd.DataFrame({"slice": list(total), "data": [v.astype(np.float32).tobytes() for v in total.values()]})


def packed(n: np.ndarray) -> np.ndarray:
    """Log odds in 1/256 and experience of slots with counts n (pairs), in 16 bits."""
    n0, n1 = n[0::2], n[1::2]
    st = np.rint(256 * np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4)))).clip(-8000, 8000).astype(np.int16)
    return st * np.int16(4) + experience(n0 + n1).astype(np.int16)


class Model:
    """A code with its packed tables and mean weights."""

    def __init__(self, code: Code, predictors: int, bits: int, rows: list, rate: float = 0.02):
        """rows: (slice, packed slots or sums of weights)."""
        self.code, self.bits, self.rate = code, bits, rate
        slices = predictors * (1 << bits) // SLICE
        self.table = np.zeros((slices, SLICE), dtype=np.int16)
        self.w = first_weights(predictors)
        for i, d in rows:
            if i < slices:
                self.table[i] = np.frombuffer(d, dtype=np.int16)
            else:
                v = np.frombuffer(d, dtype=np.float32)
                self.w[:, i - slices] = v[:-1] / v[-1]
        self.table = self.table.reshape(predictors, 1 << bits)

    def log10(self, x: np.ndarray, ctx: list, w: np.ndarray, group: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol; w: columns of weights, of which each symbol uses those from group on."""
        who, node, bit = self.code.bits(x)
        st, levels = [self.code.odds[node]], []
        for t, s in zip(self.table, places(ctx, who, node, self.bits, len(self.code.odds))):
            v = t[s]
            st.append((v >> 2).astype(np.float32) * np.float32(1 / 256))
            levels.append((v & 3).astype(np.int8))
        lp = mix(st, bit, w, group[who] + gates(levels), self.rate)
        return np.bincount(who, lp, minlength=len(x)) / np.log(10)


def finished(it):
    """Last step of the sums on executors: slices of counts are packed, weights stay sums."""
    for pdf in add_up(it):
        data = [packed(v).tobytes() if len(v := np.frombuffer(d, dtype=np.float32)) == 2 * SLICE else d for d in pdf["data"]]
        yield pdf.assign(data=data)

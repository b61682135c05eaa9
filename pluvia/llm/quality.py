"""Document statistics and a monotone boosted-tree verdict.

Null and empty texts have zero statistics and fail the base rule; repeated rows keep their own result; equal labelled rows
count as often as they stand; without labels the base rule alone decides; texts may be of any length; an empty table gives
an empty result. `filter_kept` keeps extra columns."""
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

SAMPLE = 20_000  # labelled rows the trees are fitted on, at most
FEATURES = ["n_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "bang_ratio", "distinct_ratio"]
MONOTONE = {"symbol_ratio": -1, "dup_line_ratio": -1, "repeat_ratio": -1}
_SYMBOLS = b"#*$%&|<>"


def stats(text: str | None) -> tuple:
    t = text or ""
    b = t.encode("utf-8")
    words = b.split()
    n = len(words)
    chars = len(b"".join(words).decode("utf-8")) if n else 0
    symbols = len(b) - len(b.translate(None, _SYMBOLS))
    seen, dup = set(), 0
    lines = [x for x in b.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    for x in lines:
        dup += x in seen
        seen.add(x)
    rep = 0
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=n)
    if n >= 5:
        g = np.zeros(n - 4, dtype=np.uint64)
        for k in range(5):
            g = (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k:n - 4 + k]
        _, inv, cnt = np.unique(g, return_inverse=True, return_counts=True)
        hit = np.flatnonzero(cnt[inv] > 1)
        mark = np.zeros(n + 1, dtype=np.int64)
        np.add.at(mark, hit, 1)
        np.add.at(mark, hit + 5, -1)
        rep = int((np.cumsum(mark) > 0).sum())
    m = max(n, 1)
    up = len(b) - len(b.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return (n, chars, symbols, dup, rep, chars / m, symbols / m, dup / max(len(lines), 1), rep / m, up / max(len(b), 1), b.count(b"!") / m, len(set(h.tolist())) / m)


STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _measured(texts) -> tuple[np.ndarray, np.ndarray]:
    """The five counts and the features of each text."""
    a = np.array([stats(t) for t in texts], dtype=np.float64).reshape(-1, 12)
    return a[:, :5].astype(np.int64), np.column_stack([a[:, 0], a[:, 5:]])


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, weight: np.ndarray | None = None, mono: list[int] | None = None, least: float = 20) -> dict:
    """Second-order boosting on histograms; a split against a feature's direction is refused and child bounds are kept."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])] if len(x) else []
    feat, thr, left, val, roots = [], [], [], [], []
    weight = np.ones(len(y)) if weight is None else weight
    base = float(np.log(((weight * y).sum() + 1) / ((weight * (1 - y)).sum() + 1)))
    f = np.full(len(y), base)
    mono = [MONOTONE.get(n, 0) for n in FEATURES] if mono is None else mono
    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-f))
        g, h = weight * (p - y), weight * p * (1 - p)
        roots.append(len(feat))
        feat.append(-1), thr.append(0.0), left.append(-1), val.append(0.0)
        work = [(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
        while work:
            node, idx, d, lo, hi = work.pop()
            leaf = lambda s: float(np.clip(-g[s].sum() / (h[s].sum() + 1.0), lo, hi))
            val[node] = rate * leaf(idx)
            best = (1e-6, None)
            if d < depth and weight[idx].sum() >= least:
                G, H = g[idx].sum(), h[idx].sum()
                for j, cs in enumerate(cuts):
                    b = np.searchsorted(cs, x[idx, j], side="left")
                    gl, hl = np.cumsum(np.bincount(b, g[idx], len(cs) + 1))[:-1], np.cumsum(np.bincount(b, h[idx], len(cs) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G**2 / (H + 1)
                    wl, wr = np.clip(-gl / (hl + 1), lo, hi), np.clip(-(G - gl) / (H - hl + 1), lo, hi)
                    gain[(mono[j] * (wr - wl) < 0) | (hl < 1) | (H - hl < 1)] = -1
                    if len(gain) and gain.max() > best[0]:
                        k = int(gain.argmax())
                        best = (gain[k], (j, cs[k], wl[k], wr[k]))
            if best[1]:
                j, c, wl, wr = best[1]
                feat[node], thr[node], left[node] = j, float(c), len(feat)
                mid = (wl + wr) / 2
                bl, br = ((lo, mid), (mid, hi)) if mono[j] > 0 else ((mid, hi), (lo, mid)) if mono[j] < 0 else ((lo, hi), (lo, hi))
                for child, keep in ((len(feat), x[idx, j] <= c), (len(feat) + 1, x[idx, j] > c)):
                    feat.append(-1), thr.append(0.0), left.append(-1), val.append(0.0)
                    work.append((child, idx[keep], d + 1, *(bl if child == left[node] else br)))
        tree = {"feat": np.array(feat), "thr": np.array(thr), "left": np.array(left), "val": np.array(val)}
        f += _walk(tree, roots[-1], x, depth)
    return {"feat": np.array(feat, int), "thr": np.array(thr), "left": np.array(left, int), "val": np.array(val), "roots": roots, "base": base, "depth": depth}


def _walk(t: dict, root: int, x: np.ndarray, depth: int) -> np.ndarray:
    at = np.full(len(x), root)
    for _ in range(depth):
        f = t["feat"][at]
        right = x[np.arange(len(x)), np.maximum(f, 0)] > t["thr"][at]
        at = np.where(f >= 0, t["left"][at] + right, at)
    return t["val"][at]


def predict(t: dict, x: np.ndarray) -> np.ndarray:
    f = np.full(len(x), t["base"])
    for r in t["roots"]:
        f += _walk(t, r, x, t["depth"])
    return 1 / (1 + np.exp(-f))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Fitted on at most `sample` labelled rows, the smallest by hash."""
    ids = labels.where("quality is not null and doc_id is not null").select("doc_id", "quality").orderBy(F.xxhash64("doc_id")).limit(sample)
    def run(it):
        for pdf in it:
            _, x = _measured(pdf["text"])
            yield pd.DataFrame({"y": pdf["quality"].astype(float), "x": list(x)})
    got = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").mapInPandas(run, "y double, x array<double>").toPandas()
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit_trees(x, got["y"].to_numpy(dtype=np.float64))


def _verdict(docs: DataFrame, model: dict, threshold: float):
    b = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        n, x = _measured(texts)
        bad = (n[:, 0] < 10) | (100 * n[:, 4] > 20 * n[:, 0])
        return *n.T, bad, ~bad & (predict(b.value, x) >= threshold if b.value["roots"] else True)
    return run


def score(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """doc_id, the statistics, base_failed and kept."""
    return map_texts(docs.select("doc_id", "text"), _verdict(docs, model, threshold), STATS + ", base_failed boolean, kept boolean")


def filter_kept(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that are kept, with their columns."""
    run = _verdict(docs, model, threshold)
    name = next(n for n in (f"_kept{'_' * i}" for i in range(99)) if n not in docs.columns)
    return map_texts(docs, lambda texts: run(texts)[-1:], f"{name} boolean", keep=True).where(name).select(*docs.columns)

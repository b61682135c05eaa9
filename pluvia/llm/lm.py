"""Scores of texts: smoothed word counts, and online logistic context mixing of bit predictors.

The mixing model codes a text's tokens one after another. A token is coded by its own symbol, if it is very frequent, or
by the class of its last two bytes. The bits of a symbol's Huffman code are predicted from the symbol before, from the last
token with a symbol of its own that stands before that, and from the token before itself, whichever it is. A known token of a class then has its share of it, its discounted training count; what the
discounts leave goes to new tokens by the mixed spelling model, which codes the bytes before the last two, backwards, in
the same way.

Counts come from all training tokens. The mixing weights are refined over all of them, each block predicted by what its
partition has seen before it, and averaged over the partitions; within a text they go on adapting from block to block.
Spelling is learned from distinct tokens, as it stands for those that are not known yet. Tables grow with the corpus up
to TABLE_BITS and SPELL_BITS; tokens of all kinds are counted without a bound.

Null and empty texts have the end token only; repeated rows keep their own result; a null doc_id is held out; without
training tokens all scores are those of an empty model; an empty table gives an empty result; other columns are not read.
Tokens and texts of any length are coded in blocks."""
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .coder import Code, Learner, Model, add_up, finished, mixed
from .common import written

FREQUENT, LONGEST = 65_536, 256   # tokens in the broadcast table, at most, and their bytes
OWN, CLASSES = 512, 128            # tokens with a symbol of their own, classes of last bytes
TABLE_BITS, SPELL_BITS = 22, 19   # slots of a predictor's table, as powers of two, at most
PREDICTORS = 3                    # contexts of a symbol
BLOCK = 32                        # tokens of a text after which its weights move
HELD = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 10 = 0, true)"   # a null doc_id is held out
END = b"\n"
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_LOWER = _LOW.tobytes()
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_M = 0x9E3779B97F4A7C15
_POWERS: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _M and of its inverse, to the next power of two."""
    size = 1 << max(n, 1 << 16).bit_length()
    if size not in _POWERS:
        up = lambda m: np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, m, dtype=np.uint64))))
        _POWERS.clear()
        _POWERS[size] = up(_M), up(pow(_M, -1, 1 << 64))
    return _POWERS[size]


def _final(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    return (h ^ (h >> np.uint64(15))) * np.uint64(0xD6E8FEB86659FD93)


def read(texts: list) -> tuple:
    """Lower-cased bytes of all texts; start, end, text and hash of each word."""
    bs = [(t or "").encode("utf-8") for t in texts]
    b = _LOW[np.frombuffer(b" ".join(bs), dtype=np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], ~_SPACE[b], [False]))))
    start, end = edge[0::2], edge[1::2]
    up, down = _powers(len(b))
    s = np.concatenate(([np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:len(b)])))
    ends = np.cumsum(np.fromiter(map(len, bs), dtype=np.int64, count=len(bs)) + 1)
    return b, start, end, np.searchsorted(ends, start, side="right"), _final((s[end] - s[start]) * down[start])


def hashed(tokens: list[bytes]) -> np.ndarray:
    """The hashes that read gives these words."""
    size = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    b = np.frombuffer(b"".join(tokens), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    start = np.cumsum(size) - size
    h = np.zeros(len(tokens), dtype=np.uint64)
    at = np.arange(len(b)) - np.repeat(start, size)
    np.add.at(h, np.repeat(np.arange(len(tokens)), size), b * _powers(int(size.max(initial=1)))[0][at])
    return _final(h)


def suffixes(last: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number for the last two bytes, or the only one."""
    return np.where(size > 1, last.astype(np.int64) * 256 + second, 65536 + last.astype(np.int64))


def _suffix(tokens: list[bytes]) -> np.ndarray:
    get = lambda k: np.fromiter((t[-k] if len(t) >= k else 0 for t in tokens), dtype=np.int64, count=len(tokens))
    return suffixes(get(1), get(2), np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)))


def words(t: str | None) -> list[bytes]:
    return [*(t or "").encode("utf-8").translate(_LOWER).split(), END]


def _counts(it, rows=200_000):
    """token, c: training occurrences, summed before the shuffle; tokens of held-out texts count 0."""
    c, other = Counter(), set()

    def flush():
        more = other - c.keys()
        return pd.DataFrame({"token": [*c, *more], "c": np.array([*c.values(), *[0] * len(more)], dtype=np.int64)})
    for pdf in it:
        for t, train in zip(pdf["text"], pdf["train"]):
            if train:
                c.update(words(t))
            else:
                other.update(words(t))
            if len(c) + len(other) >= rows:
                yield flush()
                c.clear()
                other.clear()
    yield flush()


class Vocabulary:
    """Symbols of tokens: own ones, then classes of last two bytes, the last of which is for all others."""

    def __init__(self, tokens: list[bytes], c: np.ndarray, n: int, v: int, groups: list, discount: float):
        """tokens, c: the most frequent ones in order; groups: (last bytes, occurrences, tokens) of all training tokens."""
        own = min(OWN, len(tokens))
        mass, kinds = np.zeros(65536 + 256), np.zeros(65536 + 256)
        of = _suffix([bytes(g[0]) for g in groups])
        mass[of], kinds[of] = [g[1] for g in groups], [g[2] for g in groups]
        mine = _suffix(tokens)
        np.subtract.at(mass, mine[:own], c[:own])
        np.subtract.at(kinds, mine[:own], 1)
        top = np.argsort(-mass, kind="stable")[:CLASSES - 1]
        top = top[mass[top] > 0]
        self.of_suffix = np.full(len(mass), own + len(top), dtype=np.int32)
        self.of_suffix[top] = own + np.arange(len(top))
        self.own, self.other, self.discount = own, own + len(top), discount
        size = self.other + 1
        self.mass = np.bincount(self.of_suffix, mass, minlength=size)
        self.kinds = np.bincount(self.of_suffix, kinds, minlength=size)
        count = np.maximum(self.mass, 1)
        count[:own] = c[:own]
        self.code = Code(np.append(count, [1] * (size < 2)))
        self.symbol = np.where(np.arange(len(tokens)) < own, np.arange(len(tokens)), self.of_suffix[mine]).astype(np.int32)
        with np.errstate(divide="ignore"):
            self.share = np.where(np.arange(len(tokens)) < own, 0.0, np.log10(np.maximum(c - discount, 1e-9) / np.maximum(self.mass[self.symbol], 1)))
        self.base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
        self.end = tokens.index(END) if END in tokens else len(tokens)
        bits = 18
        h = hashed(tokens)
        self.key, self.at, self.probes = np.zeros(1 << bits, dtype=np.uint64), np.full(1 << bits, -1, dtype=np.int32), 1
        for i, x in enumerate(h.tolist()):
            k, tries = x >> (64 - bits), 1
            while self.at[k] >= 0:
                k, tries = (k + 1) % (1 << bits), tries + 1
            self.key[k], self.at[k], self.probes = x, i, max(self.probes, tries)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the frequent tokens, or -1."""
        size = len(self.at)
        slot = (h >> np.uint64(65 - size.bit_length())).astype(np.int64)
        got = np.where(self.key[slot] == h, self.at[slot], -1)
        open_ = np.flatnonzero((got < 0) & (self.at[slot] >= 0))
        for k in range(1, self.probes):
            if not len(open_):
                break
            s = (slot[open_] + k) % size
            hit = self.key[s] == h[open_]
            got[open_[hit]] = self.at[s[hit]]
            open_ = open_[~hit & (self.at[s] >= 0)]
        return got

    def read(self, texts: list) -> tuple:
        """Places, symbols, text and hash of each token, ends included; the other tokens and their texts."""
        raw, start, end, text, h = read(texts)
        at = self.find(h)
        at[end - start > LONGEST] = -1
        x = np.where(at >= 0, self.symbol[np.maximum(at, 0)] if len(self.symbol) else 0, self.of_suffix[suffixes(raw[end - 1], raw[np.maximum(end - 2, 0)], end - start)])
        miss = np.flatnonzero(at < 0)
        line = raw.tobytes()
        rare = [line[s:e] for s, e in zip(start[miss].tolist(), end[miss].tolist())]
        where = np.arange(len(x)) + text   # each text before has an end token
        size = np.bincount(text, minlength=len(texts)) + 1
        of = np.repeat(np.arange(len(texts)), size)
        places, symbols = np.full(len(of), self.end if self.end < len(self.symbol) else -1), np.full(len(of), self.symbol[self.end] if self.end < len(self.symbol) else self.other)
        places[where], symbols[where] = at, x
        word = np.zeros(len(of), dtype=np.uint64)
        word[where] = h
        return places, symbols.astype(np.int64), of, word, rare, text[miss]

    def contexts(self, x: np.ndarray, text: np.ndarray, word: np.ndarray) -> list:
        """Every token is a context: by its symbol and, where it shares that with others, by its hash. Symbols have slots
        of their own."""
        i = np.arange(len(x))
        start = np.searchsorted(text, text)
        one = np.where(i > start, x[i - 1], self.other + 1)
        last = np.concatenate(([-1, -1], np.maximum.accumulate(np.where(x < self.own, i, -1))))[:len(x)]
        far = np.where(last >= start, x[np.maximum(last, 0)], self.own)
        shared = (one >= self.own) & (i > start)
        return [one.astype(np.int32), far.astype(np.int32), mixed(np.where(shared, word[i - 1], one.astype(np.uint64)), 1)]

    def slots(self) -> int:
        """How many slots the symbols need as contexts, without and with the end of a text."""
        return (self.other + 2) * len(self.code.odds)


BYTES = 256       # the symbol of a token's beginning, which is coded last
ORDERS = (2, 4)   # bytes of context of the spelling predictors


def _spelled(tokens: list[bytes], skip: np.ndarray, block: int = 1 << 13):
    """Blocks of symbols, contexts and token of each symbol: the bytes from behind, without the `skip` last ones; contexts
    are the bytes behind, as far as the token's end."""
    for lo in range(0, len(tokens), 4096):
        part = tokens[lo:lo + 4096]
        size = np.fromiter(map(len, part), dtype=np.int64, count=len(part)) + 1
        x = np.frombuffer(b"\0" + b"\0".join(part), dtype=np.uint8)[::-1].astype(np.int16)   # the last token first
        size, own = size[::-1], skip[lo:lo + 4096][::-1]
        ends = np.cumsum(size)
        x[ends - 1] = BYTES
        for a in range(0, len(x), block):
            at = np.arange(a, min(a + block, len(x)))
            who = np.searchsorted(ends, at, side="right")
            start = ends[who] - size[who]
            coded = at - start >= own[who]
            at, who, start = at[coded], who[coded], start[coded]
            if not len(at):
                continue
            h, ctx = np.zeros(len(at), dtype=np.int64), []
            for k in range(1, max(ORDERS) + 1):
                h = h * 257 + np.where(at - k >= start, x[np.maximum(at - k, 0)] + np.int64(1), 0)
                if k in ORDERS:
                    ctx.append(mixed(h, k))
            yield x[at].astype(np.int64), ctx, lo + len(part) - 1 - who


def _table_bits(n: int, most: int) -> int:
    return int(min(most, max(13, np.ceil(np.log2(max(n, 1))) - 3)))


def _gathered(rows: DataFrame, partitions: int) -> list:
    """Sums of the slices, from at most 64 rows of a slice in each group, step by step; the driver gets packed slices."""
    rows = rows.withColumn("part", F.spark_partition_id())
    while partitions > 64:
        partitions = -(-partitions // 64)
        rows = rows.withColumn("part", F.floor(F.col("part") / 64).cast("int"))
        rows = rows.repartition("slice", "part").mapInPandas(lambda it: _by_part(it), "slice int, data binary, part int")
    return [(r["slice"], bytes(r["data"])) for r in rows.select("slice", "data").repartition("slice").mapInPandas(finished, "slice int, data binary").collect()]


def _by_part(it):
    total: dict = {}
    for pdf in it:
        for p, rows in pdf.groupby("part"):
            total.setdefault(p, []).append(next(add_up([rows])))
            if len(total[p]) > 8:
                total[p] = [next(add_up(total[p]))]
    for p, got in total.items():
        yield next(add_up(got)).assign(part=p)


def score(v: Vocabulary, model: Model, texts: list) -> pd.DataFrame:
    """Sums over the frequent tokens of each text, the symbols of the other tokens, and these tokens."""
    n = len(texts)
    places, x, text, word, rare, of = v.read(texts)
    ctx = v.contexts(x, text, word)
    pos = np.arange(len(x)) - np.searchsorted(text, text)
    step = np.where(pos < 64 * BLOCK, pos // BLOCK, 64 + (pos - 64 * BLOCK) // (16 * BLOCK))   # later blocks are longer
    order = np.argsort(step, kind="stable")
    edges = np.concatenate(([0], np.cumsum(np.bincount(step))))
    g = model.w.shape[1]
    w, total = np.tile(model.w, n), np.zeros(n)
    for a, b in zip(edges[:-1], edges[1:]):
        for lo in range(a, b, 1 << 12):
            i = order[lo:min(b, lo + (1 << 12))]
            own = text[i]
            first, last = own[0], own[-1] + 1
            lp = model.log10(x[i], [c[i] for c in ctx], w[:, first * g:last * g], (own - first) * g)
            total[first:last] += np.bincount(own - first, lp, minlength=last - first)
    known = places >= 0
    sums = lambda a: np.bincount(text[known], a[places[known]], minlength=n)
    cut = np.searchsorted(of, np.arange(n + 1))
    return pd.DataFrame({"n_tokens": np.bincount(text, minlength=n), "n_known": np.bincount(text[known], minlength=n), "base_score": sums(v.base), "score": total + sums(v.share),
                         "rare": [rare[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]})


def _chunks(texts: list, chars: int = 400_000):
    """Places where to cut the list, so that no part has many more characters."""
    size = np.cumsum([len(t or "") + 1 for t in texts])
    at = np.flatnonzero(np.diff(size // chars, prepend=0)) + 1
    return [0, *at[at < len(texts)].tolist(), len(texts)]


def scores(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    raw = docs.select("text", F.expr(f"NOT {HELD}").alias("train"))
    parts = max(raw.rdd.getNumPartitions(), 1)
    counts = written(raw.mapInPandas(_counts, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")))
    seen = counts.where("c > 0")
    N, V, once, twice = seen.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    top = seen.where(f"length(token) <= {LONGEST}").orderBy(F.desc("c"), "token").limit(frequent).toPandas()  # so many rows of LONGEST bytes at most
    tokens, c = [bytes(t) for t in top["token"]], top["c"].to_numpy(dtype=np.int64)
    del top
    groups = seen.groupBy(F.expr("substring(token, greatest(length(token) - 1, 1), 2)").alias("s")).agg(F.sum("c"), F.count("*")).collect()  # one row for each two bytes
    v = Vocabulary(tokens, c, N, V, groups, once / (once + 2 * twice) if once else 0.5)
    least, last = (int(c[-1]), tokens[-1]) if len(c) else (1, b"")
    rest = counts.where((F.length("token") > LONGEST) | (F.col("c") < least) | (F.col("c") == least) & (F.col("token") > F.lit(bytearray(last))))

    sc, bits = docs.sparkSession.sparkContext, max(_table_bits(N, TABLE_BITS), v.slots().bit_length())
    vocabulary = sc.broadcast(v)

    def learn(it):
        v = vocabulary.value
        learner = Learner(v.code, PREDICTORS, bits)
        for pdf in it:
            texts = pdf["text"].tolist()
            at = _chunks(texts)
            for a, b in zip(at[:-1], at[1:]):
                _, x, text, word, _, _ = v.read(texts[a:b])
                ctx = v.contexts(x, text, word)
                for k in range(0, len(x), 1024):
                    learner.learn(x[k:k + 1024], [h[k:k + 1024] for h in ctx])
        yield learner.rows()
    model = sc.broadcast(Model(v.code, PREDICTORS, bits, _gathered(raw.where("train").select("text").mapInPandas(learn, "slice int, data binary"), parts)))
    lp = _rare(seen, rest, vocabulary, N, V, sc)

    def run(it):
        for pdf in it:
            texts = pdf["text"].tolist()
            at = _chunks(texts)
            for a, b in zip(at[:-1], at[1:]):
                if b > a:
                    yield pd.concat([pdf[["rid", "id", "n_bytes"]].iloc[a:b].reset_index(drop=True), score(vocabulary.value, model.value, texts[a:b])], axis=1)
    got = written(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("string").alias("id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
                  .mapInPandas(run, "rid long, id string, n_bytes long, n_tokens long, n_known long, base_score double, score double, rare array<binary>"))
    more = got.select("rid", F.explode("rare").alias("token")).join(lp, "token").groupBy("rid").agg(F.sum("known").alias("k"), F.sum("base").alias("b"), F.sum("lp").alias("s"))
    add = lambda a, x, zero: (F.col(a) + F.coalesce(F.col(x), F.lit(zero))).alias(a)
    total = got.drop("rare").join(more, "rid", "left").select(
        F.col("id").cast("long").alias("doc_id"), F.expr(HELD.replace("doc_id", "id")).alias("held_out"), "n_tokens", add("n_known", "k", 0),
        F.lit(N).cast("long").alias("train_tokens"), add("base_score", "b", 0.0), add("score", "s", 0.0), "n_bytes")
    return total.withColumn("bits_per_byte", -F.col("score") * float(np.log2(10)) / (F.col("n_bytes") + 1)).drop("n_bytes")


def _rare(seen: DataFrame, rest: DataFrame, vocabulary, n: int, size: int, sc) -> DataFrame:
    """token, known, base, lp (log10 of its share of its class) of every token of rest; spelling is learned from all
    training tokens that have no symbol of their own."""
    v = vocabulary.value
    bits = _table_bits(int(v.kinds[v.own:].sum()) * 8, SPELL_BITS)
    skipped = lambda v, tokens: np.where(v.of_suffix[_suffix(tokens)] == v.other, 0, np.fromiter((min(len(t), 2) for t in tokens), dtype=np.int64, count=len(tokens)))
    own = seen.select("token")

    def lengths(it):
        n = np.ones(BYTES + 1)
        for pdf in it:
            n[:BYTES] += np.bincount(np.frombuffer(b"".join(pdf["token"]), dtype=np.uint8), minlength=BYTES)
            n[BYTES] += len(pdf)
        yield pd.DataFrame({"k": np.arange(BYTES + 1), "n": n})
    got = own.mapInPandas(lengths, "k int, n double").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    count = np.ones(BYTES + 1)
    count[got["k"].to_numpy()] = got["n"].to_numpy()
    code = Code(count)

    def learn(it):
        v, learner = vocabulary.value, Learner(code, len(ORDERS), bits)
        for pdf in it:
            tokens = [bytes(t) for t in pdf["token"]]
            for x, ctx, _ in _spelled(tokens, skipped(v, tokens)):
                learner.learn(x, ctx)
        yield learner.rows()
    model = sc.broadcast(Model(code, len(ORDERS), bits, _gathered(own.mapInPandas(learn, "slice int, data binary"), max(own.rdd.getNumPartitions(), 1))))

    def run(it):
        v, m = vocabulary.value, model.value
        for pdf in it:
            tokens, c = [bytes(t) for t in pdf["token"]], pdf["c"].to_numpy(dtype=np.float64)
            new = np.flatnonzero(c == 0)
            fresh, spelled = [tokens[i] for i in new.tolist()], np.zeros(len(new))
            for x, ctx, who in _spelled(fresh, skipped(v, fresh)):
                np.add.at(spelled, who, m.log10(x, ctx, m.w.copy(), np.zeros(len(x), dtype=np.int64)))
            k = v.of_suffix[_suffix(tokens)]
            mass = np.maximum(v.mass[k], 1)
            lp = np.log10(np.maximum(c - v.discount, 1e-9) / mass)
            left = np.where(v.mass[k] > 0, np.maximum(v.discount * v.kinds[k], 1e-9) / mass, 1.0)
            lp[new] = spelled + np.log10(left[new])
            yield pd.DataFrame({"token": pdf["token"], "known": (c > 0).astype(np.int64), "base": np.log10((c + 0.1) / (n + 0.1 * (size + 1))), "lp": lp})
    return rest.mapInPandas(run, "token binary, known long, base double, lp double")

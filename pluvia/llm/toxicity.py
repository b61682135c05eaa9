"""Toxicity of texts after noisy-channel restoration.

A suspicious word (signs among its letters, repeated letters, letters set apart) is a lattice of what its signs may stand
for and of where words may end; exact Viterbi decoding under a character model gives the restored words. The character model has the trigrams of all texts
and, as half of its weight, those of the words that the labelled rows show to be toxic. A text's score comes from the
hashed words of its restored form.

Null and empty texts have no features and get the prior; a null doc_id is held out; repeated rows keep their own result;
labels without a document and ties in the order of rows don't matter; words and texts may be of any length; without
labels every score is 1/2; an empty table gives an empty result. labels, lang, source and doc_id are never inputs of a
score; extra columns are not read."""
import re
import unicodedata

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, BUCKETS = 40_000, 1 << 18   # labelled rows fitted on, at most; hashed features
LEXICON, SEEN = 2_000, 3            # words added to the character model, at most, and the labelled texts that hold each
STRONGEST = 3                       # features that count in one text
CACHE, LONG = 200_000, 64           # words a worker remembers before it starts again, and their bytes
#: fixed values: what a written sign may stand for
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "8": "b", "9": "g", "*": "aeiou"}
#: fixed values: letters of other scripts that look like Latin ones
ALIKE = str.maketrans("аеосрхуікмтнвАЕОСРХУІКМТНВαοειν", "aeocpxyikmthbAEOCPXYIKMTHBaoeiv")
#: fixed values: log10 costs of reading a sign as another letter, a star as a vowel, dropping a separator, a star, a repetition, a double letter, and of a word end among letters set apart and in a word
COSTS = {"leet": 0.5, "star": 0.7, "drop": 0.3, "lost": 2.0, "run": 0.1, "double": 2.5, "end": 0.0, "glued": 0.3}
LETTERS = "abcdefghijklmnopqrstuvwxyz"
_END = 26
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 or chr(c) in "@$!|+*._-" else 32 for c in range(256))
_SPACED = re.compile(rb"(?<= )[^ ](?: [^ ]){2,}(?= )")
_RUN, _DOUBLE = re.compile(rb"(.)\1\1+"), re.compile(rb"([a-z])\1")


def trigrams(words: list[bytes]) -> np.ndarray:
    """27 x 27 x 27 counts of letters after the two before; 26 is the word's end and what stands before it."""
    n = np.zeros((27, 27, 27))
    for w in words:
        a = b = _END
        for c in [*(x - 97 for x in w), _END]:
            n[a, b, c] += 1
            a, b = b, c
    return n


def log_model(n: np.ndarray, lexicon: np.ndarray | None = None) -> np.ndarray:
    """log10 probabilities, smoothed by those of the letter before alone; a lexicon's trigrams have half of the weight."""
    def smooth(n):
        two = n.sum(axis=0) + 0.5
        two /= two.sum(axis=1, keepdims=True)
        return (n + 3 * two[None]) / (n.sum(axis=2, keepdims=True) + 3)
    p = smooth(n)
    return np.log10(p if lexicon is None else 0.5 * p + 0.5 * smooth(lexicon))


def rows(lm: np.ndarray) -> list:
    """log10 probabilities of the next letter as lists, by 27 times the letter before the last and the last one; single
    values are looked up in lists faster than in arrays."""
    return lm.reshape(729, 27).tolist()


#: by sign: letters it may stand for with their numbers, the cost of reading it so, and that of dropping it, if it may be
_READ = {chr(c): ([(ord(o) - 97, o, " " + o) for o in (chr(c) if chr(c) in LETTERS else LEET.get(chr(c), ""))], 0.0 if chr(c) in LETTERS else COSTS["star" if c == 42 else "leet"],
                  COSTS["lost"] if c == 42 else None if chr(c) in LETTERS or chr(c) in LEET else COSTS["drop"]) for c in range(128)}


def viterbi(token: str, lm: list, end: float = 0.0) -> str:
    """Best restored form: each sign is kept as a letter, read through LEET, or dropped as a separator or a repetition;
    words may end between signs at the cost `end`. Exact: a path goes on by its last two letters and the signs alone, so
    the best one to each pair of letters (27 x 27 at most) is all that is kept. lm: rows() of a model."""
    states = {_END * 27 + _END: (0.0, None)}   # 27 times the letter before the last and the last one: log10 probability, letters so far as linked pairs
    before, read_before, run = "", "", 0
    for c in token:
        run = run + 1 if c == before else 1
        coded, cost, lost = _READ[c]
        again = None
        nxt: dict = {}
        opens, most = None, -np.inf   # the best path after which a word ends here
        for k, (p, w) in states.items():
            row = lm[k]
            b = k % 27
            for n, sign, _ in coded:
                q = p + row[n] - cost
                old = nxt.get(b * 27 + n)
                if old is None or old[0] < q:
                    nxt[b * 27 + n] = (q, (w, sign))
            if w is None:
                continue
            if p + row[_END] > most:
                opens, most = w, p + row[_END]
            if lost is not None:
                q = p - lost
            elif read_before and (last := w[1][-1]) in read_before and (last == c or last in LEET.get(c, "")):
                if again is None:
                    again = COSTS["run"] if run > 2 or c * 3 in token else COSTS["double"]
                q = p - again
            else:
                continue
            old = nxt.get(k)
            if old is None or old[0] < q:
                nxt[k] = (q, w)
        if opens is not None:
            row = lm[_END * 27 + _END]
            for n, _, sign in coded:
                q = most - end + row[n] - cost
                old = nxt.get(_END * 27 + n)
                if old is None or old[0] < q:
                    nxt[_END * 27 + n] = (q, (opens, sign))
        states = nxt or states   # separators before the first letter change nothing
        before, read_before = c, c + LEET.get(c, "")
    best = max(((p + lm[k][_END], w) for k, (p, w) in states.items()), key=lambda x: x[0])[1]
    out = []
    while best:
        best, o = best
        out.append(o)
    return "".join(out[::-1]) or token


class Restorer:
    """Restores words and hashes them; what a worker has seen is remembered."""

    def __init__(self, lm: np.ndarray, lexicon=frozenset()):
        self.lm, self.lexicon, self.seen, self.rows = lm, frozenset(lexicon), {}, None
        long = sorted((w for w in self.lexicon if len(w) > 4), key=lambda w: (-len(w), w))
        self.within = re.compile(b"|".join(long)) if long else None

    def __getstate__(self):
        return {"lm": self.lm, "lexicon": self.lexicon, "seen": {}, "rows": None, "within": self.within}

    def decode(self, w: bytes, end: float) -> bytes:
        self.rows = self.rows or rows(self.lm)
        return viterbi(_RUN.sub(rb"\1\1\1", w).decode("ascii"), self.rows, end).encode()

    def restore(self, w: bytes) -> bytes:
        """What one word stands for; several words where it is long and decoded."""
        core = w if len(w) == 1 and not w.isdigit() else w.strip(b"._-!|+*") or w
        if not core.isascii():
            plain = unicodedata.normalize("NFKD", core.decode("utf-8").translate(ALIKE)).encode("ascii", "ignore").lower()
            if plain in self.lexicon:
                return plain
            return core if any(x in LETTERS for x in core.decode("utf-8")) and core.decode("utf-8").isalpha() or not plain.translate(_TABLE).isascii() else self._ascii(plain.translate(_TABLE).replace(b" ", b"")) or core
        got = self._ascii(core)
        if w[:1] in b"!|+*" and len(core) > 2 and core != w and got not in self.lexicon:   # a sign in front may stand for a letter
            led = self._ascii(w.strip(b"._-").rstrip(b"!|+*"))
            return led if led in self.lexicon else got
        return got

    def _ascii(self, core: bytes) -> bytes:
        if core.isalpha():
            if not _DOUBLE.search(core):
                return core
            if not _RUN.search(core):   # double letters are common: only those that hide a known word
                one = _DOUBLE.sub(rb"\1", core)
                return one if one in self.lexicon and core not in self.lexicon else core
        elif len(core) < 2 or not any(97 <= x <= 122 for x in core):
            return core
        return self.decode(core, COSTS["glued"])

    def look(self, w: bytes) -> tuple:
        """The restored word's hashed features: the word and its beginnings of four to six bytes."""
        got = self.seen.get(w)
        if got is None:
            if w.isalpha() and not _DOUBLE.search(w):   # nothing to restore
                got = _keys(w)
            else:
                got = tuple(k for r in self.restore(w).split() for k in _keys(r))
            if len(self.seen) > CACHE:
                self.seen.clear()
            if len(w) <= LONG:
                self.seen[w] = got
        return got

    def split(self, text: str | None) -> list[bytes]:
        """Words; three or more single signs in a row, two letters among them, become decoded words."""
        line = b" " + b" ".join((text or "").encode("utf-8").translate(_TABLE).split()) + b" "
        if _SPACED.search(line):
            line = _SPACED.sub(self._joined, line)
        return line.split()

    def _joined(self, m) -> bytes:
        s = m[0].replace(b" ", b"")
        if not s.isascii() or sum(97 <= x <= 122 for x in s) < 2:
            return m[0]
        got = self.decode(s, COSTS["end"])
        return b" ".join([got, *(self.within.findall(got) if self.within else [])])   # known words that stay glued to others

    def features(self, text: str | None) -> np.ndarray:
        """Distinct hashed features; each distinct word is looked up once."""
        out: set = set()
        seen = self.seen
        for w in set(self.split(text)):
            out.update(seen.get(w) or self.look(w))
        return np.fromiter(out, dtype=np.int64, count=len(out))

    def words(self, text: str | None) -> list[bytes]:
        return [r for w in self.split(text) for r in self.restore(w).split()]


def _keys(r: bytes) -> tuple:
    h = xxhash.xxh64_intdigest
    if len(r) > 6:
        return h(r) % BUCKETS, h(b"^" + r[:4]) % BUCKETS, h(b"^" + r[:5]) % BUCKETS, h(b"^" + r[:6]) % BUCKETS
    return (h(r) % BUCKETS, *[h(b"^" + r[:k]) % BUCKETS for k in (4, 5) if len(r) > k]) if r else ()


def char_counts(docs: DataFrame) -> np.ndarray:
    """Trigrams of a-z and what stands between, over all texts."""
    def count(it):
        total = np.zeros(27**3)
        code = np.full(256, 26)
        code[97:123] = code[65:91] = np.arange(26)
        for pdf in it:
            for t in pdf["text"]:
                c = code[np.frombuffer(("  " + (t or "") + " ").encode("utf-8"), dtype=np.uint8)]
                c = c[np.concatenate(([True], (c[1:] != 26) | (c[:-1] != 26)))]
                before = np.concatenate(([26], c[:-2]))
                a = np.where(c[:-1] == 26, 26, before)   # nothing before a word's first letter counts
                total += np.bincount(a * 729 + c[:-1] * 27 + c[1:], minlength=27**3)
        yield pd.DataFrame({"k": np.arange(27**3), "n": total})
    got = docs.select("text").mapInPandas(count, "k int, n double").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(27**3)
    n[got["k"].to_numpy()] = got["n"].to_numpy()
    return n.reshape(27, 27, 27)


def fit(docs: DataFrame, labelled: DataFrame, chars: np.ndarray, sample: int = SAMPLE) -> dict:
    """labelled (doc_id, y in 0, 1); at most `sample` rows, the smallest by hash. Lower bounds of the features' log odds, of
    which a text counts the strongest, then calibrated."""
    ids = labelled.where("y is not null AND doc_id is not null").select("doc_id", "y").orderBy(F.xxhash64("doc_id")).limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    first = docs.sparkSession.sparkContext.broadcast(Restorer(log_model(chars)))

    def count(it):
        n = np.zeros((2, BUCKETS + 1), dtype=np.int64)
        for pdf in it:
            for t, y in zip(pdf["text"], pdf["y"]):
                n[y, first.value.features(t)] += 1
                n[y, BUCKETS] += 1
        k = np.flatnonzero(n)
        yield pd.DataFrame({"k": k, "n": n.ravel()[k]})
    got = rows.mapInPandas(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()  # two rows for each of BUCKETS at most
    n = np.zeros((2, BUCKETS + 1))
    n.ravel()[got["k"].to_numpy()] = got["n"].to_numpy()
    (a, b), (na, nb) = n[::-1, :BUCKETS], n[::-1, BUCKETS]
    weight = np.maximum(0, np.log((a + 0.5) / (na + 1)) - np.log((b + 0.5) / (nb + 1)) - 2 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))).astype(np.float32)
    held = docs.sparkSession.sparkContext.broadcast(weight)

    def telling(it):
        for pdf in it:
            out = []
            for t in pdf["text"]:
                ws = {w for w in first.value.words(t) if 3 < len(w) <= 32 and w.isalpha() and w.isascii()}
                out += [w for w in ws if held.value[_keys(w)[0]] > 0]
            yield pd.DataFrame({"w": out})
    top = rows.where("y = 1").mapInPandas(telling, "w binary").groupBy("w").count().where(F.col("count") >= SEEN).orderBy(F.desc("count"), "w").limit(LEXICON).collect()  # LEXICON short words at most
    lexicon = [bytes(r["w"]) for r in top]
    model = {"w": weight, "fit": np.array([1.0, 0.0]), "restorer": Restorer(log_model(chars, trigrams(lexicon) if lexicon else None), lexicon)}
    whole = docs.sparkSession.sparkContext.broadcast(model)

    def measure(it):
        for pdf in it:
            yield pd.DataFrame({"y": pdf["y"], "s": [log_odds(t, whole.value) for t in pdf["text"]]})
    seen = rows.mapInPandas(measure, "y int, s double").toPandas()  # `sample` rows at most
    model["fit"] = platt(seen["s"].to_numpy(dtype=np.float64), (seen["y"] == 1).to_numpy(dtype=np.float64))
    return model


def platt(s: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and offset of a ridge logistic fit; a single class gives slope 1."""
    a = np.array([1.0, np.log((y.sum() + 1) / (len(y) - y.sum() + 1))])
    x = np.column_stack([s, np.ones(len(s))])
    for _ in range(25 if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-(x @ a).clip(-30, 30)))
        a += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.1 * np.eye(2), x.T @ (y - p) - 0.1 * (a - [1, 0]))
        a[0] = max(a[0], 0.0)
    return a


def log_odds(text: str | None, model: dict) -> float:
    w = model["w"][model["restorer"].features(text)]
    return float(model["fit"][0] * (w if len(w) <= STRONGEST else np.partition(w, -STRONGEST)[-STRONGEST:]).sum() + model["fit"][1])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    b = docs.sparkSession.sparkContext.broadcast(model)

    def run(it):
        for pdf in it:
            z = np.array([log_odds(t, b.value) for t in pdf["text"]], dtype=np.float64)
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            yield pd.DataFrame({"id": pdf["id"], "score": p, "predicted": (p >= 0.5).astype(np.int32)})
    got = docs.selectExpr("string(doc_id) AS id", "text").mapInPandas(run, "id string, score double, predicted int")  # text keeps null ids apart from the numbers
    return got.select(F.col("id").cast("long").alias("doc_id"), F.expr("coalesce(crc32(cast(id as binary)) % 5 = 0, true)").alias("held_out"), "score", "predicted")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels are learned only from rows that aren't held out."""
    train = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").selectExpr("doc_id", "toxic AS y")
    return score(docs, fit(docs, train, char_counts(docs)))

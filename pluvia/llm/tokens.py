"""Token counts by a broadcast table of frequent pieces and worker caches; nothing is shuffled but the bounded table.

A piece that the caches miss and that is letters with closing punctuation goes to the vocabulary's merges directly, any
other one through the whole tokenizer. Null and empty texts count 0; special strings in a text count as the library
counts them; repeated rows keep their own result; an empty table gives an empty result; texts may be of any length;
extra columns are not read."""
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

FREQUENT = 65_536   # rows of the broadcast table, at most
HEAVY = 4_096       # candidates each input partition proposes
CACHE = 400_000     # pieces a worker remembers before it starts again
LONG = 256          # bytes of a piece over which it is encoded again rather than remembered
#: letters that lower case and composition leave single, then punctuation that starts neither a contraction nor a special string
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?)]*)")
_STATE: dict = {}


def pieces(text: str | None) -> list[bytes]:
    """White-space pieces: the vocabulary's normaliser drops white space and no token crosses it."""
    return (text or "").encode("utf-8").split()


def _byte_signs() -> dict[int, int]:
    """The sign that stands for each byte in a byte-level vocabulary: printable ones stand for themselves, the others
    follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b if b in own else 256 + sum(c not in own for c in range(b)) for b in range(256)}


class Sizes(dict):
    """Tokens of a piece; a missing one is encoded and remembered."""

    def __init__(self, path: str, known: dict | None = None):
        from tokenizers import Tokenizer, models
        super().__init__(known or {})
        self.tok, self.known = Tokenizer.from_file(path), known or {}
        self.signs = _byte_signs() if isinstance(self.tok.model, models.BPE) and _plain_letters(self.tok) else None

    def __missing__(self, piece: bytes) -> int:
        text = piece.decode("utf-8")
        m = _PLAIN.fullmatch(text) if self.signs else None
        if m is None:
            n = len(self.tok.encode(text, add_special_tokens=False).ids)
        else:
            letters = m[1].lower().encode("utf-8").decode("latin-1").translate(self.signs)
            n = len(self.tok.model.tokenize(letters)) + (self[m[2].encode()] if m[2] else 0)
        if len(piece) <= LONG:
            self[piece] = n
        return n

    def total(self, ps: list[bytes]) -> int:
        n = sum(map(self.__getitem__, ps))
        if len(self) > CACHE + len(self.known):
            self.clear()
            self.update(self.known)
        return n


def _plain_letters(tok) -> bool:
    """Whether this vocabulary lower-cases letters, takes a run of them as one pre-token and parts it from punctuation."""
    probe = "QuÉüz"
    parts = [p for p, _ in tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(probe + "?!)"))] if tok.normalizer and tok.pre_tokenizer else []
    return parts == [probe.lower().encode().decode("latin-1").translate(_byte_signs()), "?!)"]


def frequent(docs: DataFrame) -> DataFrame:
    """Heavy pieces: each partition proposes its HEAVY most frequent, the FREQUENT largest sums stay."""
    def propose(it):
        c: Counter = Counter()
        for pdf in it:
            for t in pdf["text"]:
                c.update(pieces(t))
            if len(c) > CACHE:
                c = Counter(dict(c.most_common(CACHE // 4)))
        top = c.most_common(HEAVY)
        yield pd.DataFrame({"piece": [k for k, _ in top], "n": [v for _, v in top]})
    got = docs.select("text").mapInPandas(propose, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return got.where("length(piece) <= 64").orderBy(F.desc("n"), "piece").limit(FREQUENT)


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    rows = [bytes(r.piece) for r in frequent(docs).select("piece").collect()]  # FREQUENT rows of 64 bytes at most
    sizes = Sizes(path)
    table = docs.sparkSession.sparkContext.broadcast({p: sizes[p] for p in rows})

    def count(texts):
        if _STATE.get("of") is not table.value:
            _STATE.update(of=table.value, sizes=Sizes(path, table.value))
        n = np.array([_STATE["sizes"].total(pieces(t)) for t in texts], dtype=np.int64)
        return [len((t or "").encode("utf-8")) for t in texts], n, n > limit
    return map_texts(docs.select("doc_id", "text"), count, "n_bytes long, n_tokens long, over_limit boolean")

"""Ranked lexical search by geometric blocking of posting lists, with exact results.

Documents are taken in shards, as they lie in their partitions. In a shard the posting list of each term is clustered by
the similarity of its documents: every document has a sketch (a random projection of its impacts), some of the list's
documents are centres, and a block is what lies nearest to one centre. A block keeps the largest impact of its documents
for each term that is asked together with its own. The sum of these, weighted by a query's terms, is never below the score
of one of its documents, so a block is left out only where that sum is below the score of the k-th best document so far;
what remains is scored exactly. No posting list is shuffled, so a term that most documents hold makes no large task; the
k best of each task go on.

Queries are collected in blocks of BLOCK_BYTES of text; each block's terms and weights are sent to the tasks, and each
further block is another pass over the documents.

Null and empty texts, and ones without a term, match nothing; equal scores go by ascending doc_id, a null one last;
repeated rows are ranked each by itself; texts may be of any length; an empty table gives an empty result; other columns
are not read."""
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_BYTES = 4 << 20   # of the queries' texts that are sent to every task at once
SHARD, CELLS = 2048, 16 << 20   # documents of a shard at most, and numbers of its table of documents by terms
MEMBERS = 32            # documents of a block on average
SKETCH = 32             # numbers of a sketch
#: A-Z lower-cased; digits, letters and bytes of other signs stay, all others part terms
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32) for c in range(256))
_LAST = np.iinfo(np.int64).max


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_TABLE).split()


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Queries:
    """A block of queries: terms by number, how often each query holds them, and which terms are asked together."""

    def __init__(self, texts: list[str | None]):
        counts = [Counter(terms(t)) for t in texts]
        self.vocab = {t: k for k, t in enumerate(sorted(set().union(*counts)))}
        self.terms = [np.array(sorted(self.vocab[t] for t in c), dtype=np.int64) for c in counts]
        named = list(self.vocab)
        self.times = [np.array([c[named[k]] for k in ts], dtype=np.int64) for c, ts in zip(counts, self.terms)]
        self.of: list[list[int]] = [[] for _ in named]   # queries of a term
        for q, ts in enumerate(self.terms):
            for t in ts:
                self.of[t].append(q)
        self.near = [self._together(t) for t in range(len(named))]

    def _together(self, t: int):
        """The terms of all queries that hold t; None stands for every term, which needs no list of its own."""
        if sum(len(self.terms[q]) for q in self.of[t]) > len(self.vocab):
            return None
        return np.unique(np.concatenate([self.terms[q] for q in self.of[t]]))


class Best:
    """The k best documents of a query so far."""

    def __init__(self, k: int):
        self.k, self.score, self.doc = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self) -> int:
        """What a document must score to be among them, or to tie with the last."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        on = score >= self.floor()
        score, doc = np.concatenate([self.score, score[on]]), np.concatenate([self.doc, doc[on]])
        order = np.lexsort((doc, -score))[:self.k]
        self.score, self.doc = score[order], doc[order]


class Shard:
    """Documents by terms, and the blocks of every posting list."""

    def __init__(self, queries: Queries, weights: np.ndarray, ids: list, found: list[tuple[np.ndarray, np.ndarray]]):
        """found: the numbers of a document's terms and their impacts."""
        self.q, self.w = queries, weights
        self.ids = np.array([_LAST if i is None else i for i in ids], dtype=np.int64)
        size = np.array([len(t) for t, _ in found])
        self.x = np.zeros((len(ids), len(weights)), dtype=np.int32)
        row = np.repeat(np.arange(len(ids)), size)
        col = np.concatenate([t for t, _ in found])
        self.x[row, col] = np.concatenate([p for _, p in found])
        order = np.argsort(col, kind="stable")
        self.lists = np.split(row[order], np.cumsum(np.bincount(col, minlength=len(weights)))[:-1])
        sketch = np.zeros((len(ids), SKETCH), dtype=np.float32)
        signs = np.random.default_rng(11).choice(np.array([-1, 1], dtype=np.float32), (len(weights), SKETCH))
        step = max(1, CELLS // (4 * max(1, len(weights))))
        for k in range(0, len(ids), step):
            sketch[k:k + step] = (self.x[k:k + step] * weights.astype(np.float32)) @ signs
        self.sketch = sketch / np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
        self.visited = self.blocks = 0

    def clustered(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """The posting list of a term in the order of its blocks, and where each block begins."""
        docs = self.lists[t]
        if len(docs) <= MEMBERS:
            return docs, np.zeros(1, dtype=np.int64)
        n = -(-len(docs) // MEMBERS)
        centres = docs[np.arange(n) * len(docs) // n]
        at = (self.sketch[docs] @ self.sketch[centres].T).argmax(axis=1)
        order = np.argsort(at, kind="stable")
        return docs[order], np.flatnonzero(np.diff(at[order], prepend=-1))

    def bounds(self) -> tuple[list, list, list, list]:
        """For each query the bounds of its terms' blocks and their numbers; members and ends of all blocks."""
        bound, which = [[] for _ in self.q.terms], [[] for _ in self.q.terms]
        members, begins, seen, total = [], [], 0, 0
        for t, docs in enumerate(self.lists):
            if not len(docs):
                continue
            docs, starts = self.clustered(t)
            near = self.q.near[t]
            rows = self.x[docs] if near is None else self.x[docs[:, None], near]
            summary = np.maximum.reduceat(rows, starts, axis=0)
            own = np.arange(total, total + len(starts))
            for q in self.q.of[t]:
                ts = self.q.terms[q]
                at = ts if near is None else np.searchsorted(near, ts)
                bound[q].append(summary[:, at] @ (self.w[ts] * self.q.times[q]))
                which[q].append(own)
            members.append(docs)
            begins.append(starts + seen)
            seen += len(docs)
            total += len(starts)
        cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        begin = np.append(cat(begins), seen)
        self.blocks = total
        return [cat(b) for b in bound], [cat(b) for b in which], cat(members), begin

    def search(self, best: list[Best]) -> None:
        """Takes this shard's documents into the best ones of each query."""
        bound, which, members, begin = self.bounds()
        for q, top in enumerate(best):
            if not len(bound[q]):
                continue
            ts, w = self.q.terms[q], self.w[self.q.terms[q]] * self.q.times[q]
            order = np.argsort(-bound[q], kind="stable")
            done, at, step = np.zeros(len(self.ids), dtype=bool), 0, 4
            while at < len(order):
                go = order[at:at + step]
                go = go[bound[q][go] >= top.floor()]
                if not len(go):
                    break   # bounds descend: no later block holds a better document
                self.visited += len(go)
                docs = np.unique(np.concatenate([members[begin[b]:begin[b + 1]] for b in which[q][go]]))
                docs = docs[~done[docs]]
                done[docs] = True
                top.add(self.x[docs[:, None], ts] @ w, self.ids[docs])
                at, step = at + step, step * 2


def blocks(queries: DataFrame, id_column: str, size: int) -> Iterator[tuple[list, list]]:
    """Ids and texts of the queries, of `size` bytes of text at once, or of one longer text."""
    ids, texts, held = [], [], 0
    for r in queries.select(F.col(id_column).cast("long").alias("i"), "text").toLocalIterator():
        n = len((r["text"] or "").encode("utf-8"))
        if texts and held + n > size:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(r["i"])
        texts.append(r["text"])
        held += n
    if texts:
        yield ids, texts


def statistics(docs: DataFrame, queries: Queries) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents of each of the queries' terms: a row a term and task is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(queries.vocab)

    def count(batches):
        vocab = sent.value
        df, n, total = np.zeros(len(vocab), dtype=np.int64), 0, 0
        for b in batches:
            for t in b.column("text").to_pylist():
                w = terms(t)
                n, total = n + bool(w), total + len(w)
                for k in vocab.keys() & set(w):
                    df[vocab[k]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *at.tolist()], pa.int64()), pa.array([n, total, *df[at].tolist()], pa.int64())], ["k", "n"])
    got = {r.k: r.n for r in docs.select("text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    return got.get(-1, 0), got.get(-2, 0), np.array([got.get(k, 0) for k in range(len(queries.vocab))], dtype=np.int64)


def _one_block(docs: DataFrame, ids: list, texts: list, k: int, shard: int) -> DataFrame:
    queries = Queries(texts)
    n_docs, n_terms, df = statistics(docs, queries)
    weights = np.array([term_weight(n_docs, int(x)) for x in df], dtype=np.int64)
    sent = docs.sparkSession.sparkContext.broadcast((queries, weights))
    most = max(1, min(shard, CELLS // max(1, len(weights))))

    def run(batches):
        queries, weights = sent.value
        best = [Best(k) for _ in queries.terms]
        own, found = [], []

        def flush():
            if own:
                Shard(queries, weights, own, found).search(best)
                own.clear()
                found.clear()
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                w = terms(t)
                tf = Counter(map(queries.vocab.get, w))
                tf.pop(None, None)
                if tf:
                    m = 25 + 75 * len(w) * n_docs // n_terms
                    at, f = np.array(list(tf), dtype=np.int64), np.array(list(tf.values()), dtype=np.int64)
                    own.append(i)
                    found.append((at, (1_000_000_000 * f) // (1000 * f + 8 * m)))
                    if len(own) >= most:
                        flush()
        flush()
        size = [len(b.score) for b in best]
        doc = np.concatenate([b.doc for b in best]) if best else np.zeros(0, np.int64)
        score = np.concatenate([b.score for b in best]) if best else np.zeros(0, np.int64)
        at = np.repeat(np.arange(len(best)), size)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([ids[q] for q in at.tolist()], pa.int64()), pa.array(doc, pa.int64(), mask=doc == _LAST), pa.array(score, pa.int64())], ["q", "item_id", "doc_id", "score"])
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "q long, item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return got.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "item_id", block_bytes: int = BLOCK_BYTES, shard: int = SHARD) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each query."""
    parts = [_one_block(docs, ids, texts, k, shard) for ids, texts in blocks(queries, id_column, block_bytes)]
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.union, parts)


_TERM = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL = f"""WITH i AS (SELECT item_id, unnest({_TERM}) AS t FROM benchmark), qt AS (SELECT item_id, t, count(*) AS c FROM i GROUP BY 1, 2),
d AS (SELECT doc_id, {_TERM} AS l FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, l, len(l) AS n FROM d WHERE len(l) > 0),
tot AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM s),
e AS (SELECT doc_id, n, unnest(l) AS t FROM s), tf AS (SELECT doc_id, n, t, count(*) AS tf FROM e WHERE t IN (SELECT t FROM qt) GROUP BY 1, 2, 3),
w AS (SELECT t, CAST(floor(1000 * ln((2 * (SELECT nn FROM tot) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf GROUP BY 1),
x AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))) AS p FROM tf JOIN w USING (t), tot),
sc AS (SELECT item_id, doc_id, CAST(sum(c * p) AS BIGINT) AS score FROM qt JOIN x USING (t) GROUP BY 1, 2 HAVING sum(c * p) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM sc
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""

"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

A bounded set of labelled texts (``PER_CLASS`` distinct texts a class, chosen by a hash) is held in
an inverted index: words of few examples as postings, words of many examples cut into blocks of
``BLOCK`` examples alike with the largest weight of each block. A text's similarity to the examples
of a block cannot exceed what the words of few examples give one of them plus the sum of the other
word weights times the block maxima; blocks are opened in descending order of that bound until no
closed block can reach the k-th best similarity, so the k neighbours are exact. Their number is the
square root of the number of examples. Their votes, weighted by the inverse of the cosine distance
and by the word beginnings (``BEGIN`` letters) they share with the text that tell the classes apart (a few
such words hardly move the cosine of a long text), become a probability by isotonic regression on the
examples' leave-one-out votes, weighted to the classes' shares among all labelled rows. A beginning tells
them apart by the logarithm of the ratio of the classes' shares of examples that hold it, if that is above
``SURE`` standard errors; examples of a cosine of at least ``ALIKE`` count as one.

Weights are (1 + ln tf) * ln(1 + N / df) over all words of the examples; df and N are counted over
all documents. A text's words that no example has would lengthen it against every example alike:
they are left out of its length. Words are runs of letters, lower-cased, of the whole text.

Defined results: texts that share no word with the index (null, empty) get the share of toxic
labels; without any label the score is 0; null labels are not learned, a document with several
labels counts as toxic if one says so; equal similarities go to the earlier example; repeated
rows are scored each. Scoring adds columns by name and reads the text only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentio.llm.op7_language import held_out

PER_CLASS = 1000
BLOCK = 16
THRESHOLD = 0.7
SURE = 3.0
ALIKE = 0.8
BEGIN = 5

_WORD = re.compile(r"[^\W\d_]+")


def term_counts(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def beginnings(counts: Counter) -> set[str]:
    """The first ``BEGIN`` letters of the words: what forms of one word share."""
    return {w[:BEGIN] for w in counts}


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted isotonic regression by pooling: knots (x, value) for linear interpolation."""
    pools: list[list[float]] = []  # weight, mean, sum of weight * x
    for i in np.argsort(x, kind="stable"):
        pools.append([w[i], y[i], w[i] * x[i]])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            a, b = pools[-2], pools.pop()
            pools[-1] = [a[0] + b[0], (a[0] * a[1] + b[0] * b[1]) / (a[0] + b[0]), a[2] + b[2]]
    return np.array([p[2] / p[0] for p in pools]), np.array([p[1] for p in pools])


def alike_blocks(rows: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """The block of each example: examples are halved along the direction in which a signed
    256-column sketch of their vectors varies most, until at most ``size`` are left, so that a
    block holds examples alike and the maxima of its words say much about each of them."""
    sketch = np.zeros((len(rows), 256))
    for i, (term, w) in enumerate(rows):
        np.add.at(sketch[i], term % 256, np.where(term // 256 % 2, w, -w))
    block = np.zeros(len(rows), np.int64)
    todo, made = [np.arange(len(rows))], 0
    while todo:
        some = todo.pop()
        if len(some) <= size:
            block[some] = made
            made += 1
            continue
        part = sketch[some] - sketch[some].mean(axis=0)
        along = part @ np.linalg.eigh(part.T @ part)[1][:, -1]
        some = some[np.argsort(along, kind="stable")]
        half = -(-len(some) // size) // 2 * size
        todo += [some[half:], some[:half]]
    return block


def spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges begin .. end - 1, one after the other, and the range of each."""
    size = end - begin
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) + (begin - np.cumsum(size) + size)[of], of


class ExampleIndex:
    """Block-max inverted index over labelled examples, and the calibrated vote."""

    def __init__(self, ids: list, texts: list[str], labels: list[int], df: dict[str, int], n_docs: int, base: float,
                 k: int | None = None):
        self.ids, self.labels, self.base = list(ids), np.array(labels, float), base
        self.k = k or max(1, round(math.sqrt(len(self.ids))))
        counts = [term_counts(t) for t in texts]
        vocab = sorted(set().union(*counts))
        self.terms = {w: i for i, w in enumerate(vocab)}
        self.idf = np.log1p(n_docs / np.array([max(1, df.get(w, 1)) for w in vocab], float))
        rows = [self.vector(c) for c in counts]
        block = alike_blocks(rows, BLOCK)
        self.blocks = int(block.max(initial=0)) + 1
        term = np.concatenate([r[0] for r in rows] or [np.zeros(0, np.int64)])
        example = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        weight = np.concatenate([r[1] for r in rows] or [np.zeros(0)])
        # place of an example: its block's number times BLOCK, plus its number in the block
        self.place = np.empty(len(rows), np.int64)
        for b in range(self.blocks):
            self.place[block == b] = b * BLOCK + np.arange((block == b).sum())
        place = self.place[example]
        # words of at least a quarter of the examples: a full row of weights each, so that a block is
        # a slice of it (a sixteenth or half: slower by a quarter or a third, same neighbours)
        held = np.bincount(term, minlength=len(vocab))
        often = np.flatnonzero(held >= max(2, len(rows) / 4))
        self.row = np.full(len(vocab), -1)
        self.row[often] = np.arange(len(often))
        self.full = np.zeros((len(often), self.blocks, BLOCK))
        some = self.row[term] >= 0
        self.full[self.row[term[some]], place[some] // BLOCK, place[some] % BLOCK] = weight[some]
        self.full_most = self.full.max(axis=2)
        # other words: postings
        order = np.lexsort((place[~some], term[~some]))
        self.at, self.weight = place[~some][order], weight[~some][order]
        self.first = np.searchsorted(term[~some][order], np.arange(len(vocab) + 1))
        # how many examples of each class hold a beginning (those alike count as one together, or a copied text
        # would make its words look sure), and the beginnings that surely tell the classes apart
        near = [self.nearest(*r, skip=i) for i, r in enumerate(rows)]
        self.counts = np.array([1 / (1 + (c >= ALIKE).sum()) for _, c in near])
        self.size = np.bincount(self.labels.astype(int), self.counts, 2)
        begins = [beginnings(c) for c in counts]
        all_of = sorted(set().union(*begins))
        number = {x: i for i, x in enumerate(all_of)}
        self.held, holds = np.zeros((2, len(all_of))), [np.array([number[x] for x in some], np.int64) for some in begins]
        for i, some in enumerate(holds):
            self.held[int(self.labels[i]), some] += self.counts[i]
        telling = np.flatnonzero(self.telling(np.arange(len(all_of))))
        self.told = {all_of[x]: i for i, x in enumerate(telling)}
        self.held = self.held[:, telling]
        self.sure = self.telling(np.arange(len(telling)))
        self.holds = np.zeros((len(telling), len(rows)), bool)
        for i, some in enumerate(holds):
            self.holds[:, i] = np.isin(telling, some)
        votes = np.array([self.vote(*near[i], self.holds[:, i].nonzero()[0], skip=i) for i in range(len(rows))])
        if len(rows):
            share = np.where(self.labels == 1, base / max(1, (self.labels == 1).sum()), (1 - base) / max(1, (self.labels == 0).sum()))
            self.knots = isotonic(votes, self.labels, share + 1e-12)

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Sorted terms of the vocabulary and their weights at length 1."""
        term = np.fromiter(map(self.terms.get, counts, repeat(-1)), np.int64, len(counts))
        tf = np.fromiter(counts.values(), float, len(counts))[term >= 0]
        term = term[term >= 0]
        w = (1 + np.log(tf)) * self.idf[term]
        return term, w / max(np.sqrt((w * w).sum()), 1e-300)

    def nearest(self, term: np.ndarray, q: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k most similar examples (without ``skip``) and their cosines, largest first."""
        n = len(self.ids)
        self.opened = 0
        if not len(term) or not n:
            return np.zeros(0, np.int64), np.zeros(0)
        row = self.row[term]
        often, q_often = row[row >= 0], q[row >= 0]
        # the words of few examples first, in full: what they give is a floor of every similarity
        at, of = spread(self.first[term], self.first[term + 1])
        sums = np.bincount(self.at[at], q[of] * self.weight[at], self.blocks * BLOCK).astype(float)
        grid = sums.reshape(-1, BLOCK)
        if skip >= 0:
            sums[self.place[skip]] = -1
        bound = grid.max(axis=1) + q_often @ self.full_most[often]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        step = 1 + self.k // BLOCK
        while len(order):
            some = order[:step]
            grid[some] += (q_often @ self.full[often[:, None], some].reshape(len(often), len(some) * BLOCK)).reshape(-1, BLOCK)
            self.opened += len(some)
            if skip >= 0:
                sums[self.place[skip]] = -1
            # a closed block's sums lack the frequent words, so the k-th best so far is a lower
            # bound; a hair of slack keeps rounding from closing a block that could tie
            kth = np.partition(sums, -self.k)[-self.k] if n >= self.k else 0.0
            order = order[step:]
            order = order[bound[order] * (1 + 1e-9) >= kth]
            step = max(4, len(order) // 2)
        sums = sums[self.place]
        best = np.lexsort((np.arange(n), -sums))[:self.k] if n <= self.k else self._top(sums)
        best = best[sums[best] > 0]
        return best, sums[best]

    def _top(self, sums: np.ndarray) -> np.ndarray:
        kth = np.partition(sums, -self.k)[-self.k]
        some = np.flatnonzero(sums >= kth)
        return some[np.lexsort((some, -sums[some]))][:self.k]

    def telling(self, some: np.ndarray, skip: int = -1) -> np.ndarray:
        """How beginnings tell the classes apart: the logarithm of the ratio of the classes' shares that hold one (the
        larger one above), 0 unless above ``SURE`` standard errors. Without the example ``skip``, which holds them."""
        n, held = self.size.copy(), self.held[:, some]
        if skip >= 0:
            y = int(self.labels[skip])
            n[y] -= self.counts[skip]
            held[y] = np.maximum(0, held[y] - self.counts[skip])
        ratio = np.log((held[1] + 0.5) / (n[1] + 1)) - np.log((held[0] + 0.5) / (n[0] + 1))
        return np.where(np.abs(ratio) > SURE * np.sqrt((1 / (held + 0.5)).sum(axis=0)), np.abs(ratio), 0.0)

    def vote(self, best: np.ndarray, cosine: np.ndarray, told: np.ndarray, skip: int = -1) -> float:
        """Share of toxic ones among the neighbours, each counted by the inverse of its distance plus 0.1, times
        the ratios of the text's telling beginnings ``told`` that it shares."""
        if not len(best):
            return self.base
        w = 1 / (1.1 - np.minimum(cosine, 1))
        if len(told):
            shared = (self.sure[told] if skip < 0 else self.telling(told, skip)) @ self.holds[told[:, None], best]
            w *= np.exp(shared - shared.max())
        return float((w * self.labels[best]).sum() / w.sum())

    def score(self, text: str | None) -> tuple[float, list[str]]:
        """Calibrated probability and the three nearest examples as ``id:label:cosine``."""
        counts = term_counts(text)
        best, cosine = self.nearest(*self.vector(counts))
        if not len(best):
            return self.base, []
        told = np.array([self.told[x] for x in sorted(self.told.keys() & beginnings(counts))], np.int64)
        p = float(np.interp(self.vote(best, cosine, told), *self.knots))
        return min(1.0, max(0.0, p)), [f"{self.ids[i]}:{int(self.labels[i])}:{c:.4f}" for i, c in zip(best[:3], cosine[:3], strict=True)]


def document_frequencies(docs: DataFrame, vocab: set[str], text: str = "text") -> tuple[dict[str, int], int]:
    """Number of documents with each word of ``vocab`` (bounded by the examples), and of all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got, n = Counter(), 0
        for b in batches:
            n += len(b)
            for t in b["t"]:
                got.update(shared.value.intersection(set(_WORD.findall((t or "").lower()))))
        yield pd.DataFrame([*got.items(), ("", n)], columns=["w", "n"])

    rows = (docs.select(F.col(text).cast("string").alias("t")).mapInPandas(count, "w string, n long")
            .groupBy("w").agg(F.sum("n").alias("n")).collect())
    df = {r["w"]: r["n"] for r in rows}
    return df, df.pop("", 0)


def learn(docs: DataFrame, labels: DataFrame, allowed=None, per_class: int = PER_CLASS, doc_id: str = "doc_id", text: str = "text",
          label: str = "toxic") -> ExampleIndex:
    """The index from at most ``per_class`` distinct labelled texts a class. ``allowed``: a predicate
    on a doc_id column that says which labels may be learned."""
    y = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    if allowed is not None:
        y = y.where(allowed(F.col("id")))
    y = y.groupBy("id").agg(F.max("y").alias("y"))
    own = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("h")).where(F.col(text).isNotNull())
    texts = own.join(y, "id").groupBy("h").agg(F.max("y").alias("y"), F.min("id").alias("id"), F.count("*").alias("n"))
    per_y = texts.groupBy("y").agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect()
    shares = {r["y"]: r["n"] for r in per_y}
    # the smallest hashes of a class are its examples: all above a bound that leaves twice as many go
    # before the window, so that its task holds no more however many tasks read the labels
    low = F.lit(True)
    for r in per_y:
        part = (2 * per_class + 100) / r["d"]
        if part < 1:
            low = low & ((F.col("y") != r["y"]) | (F.col("h") <= int(2 ** 64 * part) - 2 ** 63))
    order = Window.partitionBy("y").orderBy("h")
    chosen = {r["h"]: r for r in texts.where(low).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_class).collect()}
    found: dict = {}
    if chosen:
        # by hash, a row for each text: an id that stands on several texts brings none but those labelled
        wanted = docs.select(F.xxhash64(F.col(text)).alias("h"), F.col(text).cast("string").alias("t")).where(
            F.col("h").isin(list(chosen)) & F.col("t").isNotNull())
        found = {r["h"]: r["t"] for r in wanted.groupBy("h").agg(F.min("t").alias("t")).collect()}
    picked = sorted(found, key=lambda h: (chosen[h]["id"], h))
    texts_found = [found[h] for h in picked]
    vocab = {w for t in texts_found for w in term_counts(t)}
    df, n = document_frequencies(docs, vocab, text) if picked else ({}, 0)
    base = shares.get(1, 0) / max(1, sum(shares.values()))
    return ExampleIndex([chosen[h]["id"] for h in picked], texts_found, [chosen[h]["y"] for h in picked], df, n, base)


def with_toxicity(docs: DataFrame, index: ExampleIndex, text: str = "text", score: str = "score", evidence: str = "evidence") -> DataFrame:
    """All columns of ``docs``, the score of every whole text and its evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("score double, evidence array<string>")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            # copies within a batch are scored once
            which, distinct = pd.factorize(texts, use_na_sentinel=False)
            judged = pd.DataFrame([shared.value.score(t if isinstance(t, str) else None) for t in distinct], columns=["score", "evidence"])
            yield judged.take(which).reset_index(drop=True)

    return docs.withColumn("_judged", judge(F.col(text))).withColumns(
        {score: F.col("_judged.score"), evidence: F.col("_judged.evidence")}).drop("_judged")


def learnable(doc_id) -> object:
    return ~held_out(doc_id, 3, 1)


def op8_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    index = learn(docs, labels, learnable)
    rows = with_toxicity(docs.select("doc_id", "text"), index)
    return rows.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score",
                       (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")

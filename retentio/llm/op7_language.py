"""Language ID by cross-parsing entropy.

Per language a suffix automaton of labelled text is built. A text is parsed greedily into
phrases, each the longest match with the automaton plus nothing more (a letter that matches
nowhere is a phrase of its own). The language with the fewest normalised phrases,
phrases * log2(training length) / letters, wins: that is the Ziv-Merhav estimate of the cross
entropy in bits a letter.

The transitions of all automata lie in one array by row displacement: those of a state at its place
plus the letter, each with its owner's place, the rows of different states fitted into each other's gaps. Its
size goes with the number of transitions (at most three a training letter), not with states times
letters, so many languages and large scripts stay small. Tasks parse many whole texts at once with
numpy, letter by letter, at most ``TOGETHER`` letters (or one longer text) at a time, held as codes of
one byte each (two where the scripts learned have more than 255 letters).

Learning uses a bounded sample: at most ``TRAIN_ROWS`` rows a language, chosen by a hash of
doc_id, each with at most ``ROW_LETTERS`` letters, ``TRAIN_LETTERS`` in all. The rows are chosen by
hashes alone; the texts of the chosen ones are fetched after. Equal rows among them are learned once.

Defined results: null text or text without letters gives ``und`` and score 0; without any
learned language every text is ``und``; equal rates go to the first language in code-point
order; null labels and labels equal to ``und`` are not learned; repeated rows are predicted each.
Prediction adds columns by name and reads the text only; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentio.llm.common import discard, saved

TRAIN_ROWS = 60
ROW_LETTERS = 400
TRAIN_LETTERS = 16_000
TOGETHER = 16_000_000
SHARPNESS = 6.0   # of the score: logistic in the difference of the rates


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))


_LETTERS: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTERS:
        table = np.zeros(0x110000, bool)
        table[[i for i in range(0x110000) if chr(i).isalpha()]] = True
        _LETTERS.append(table)
    return _LETTERS[0]


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points, every run of other characters than letters as one 0."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    cp = np.where(_is_letter()[cp], cp, 0)
    keep = np.ones(len(cp), bool)
    keep[1:] = (cp[1:] != 0) | (cp[:-1] != 0)
    return cp[keep]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence, state 0 the start."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return nxt


def displaced(rows: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row displacement of sparse rows with columns below ``width`` and row numbers as values: (place of
    each row, array of place << 32 | place of the value's row, -1 where nothing lies). No two rows with
    columns have one place; rows without columns have place 0, which is no other row's.
    ``place[row] + column`` is always in the array."""
    used = bytearray(2 * sum(map(len, rows)) + 2 * width + 2)
    place = np.zeros(len(rows), np.int64)
    taken = {0}
    first: dict[int, int] = {}   # where the search for a row of so many columns goes on
    free = width + 1
    for row in sorted(range(len(rows)), key=lambda r: (-len(rows[r]), r)):
        columns = sorted(rows[row])
        if not columns:
            continue
        single = len(columns) == 1   # any gap will do
        at = free - columns[0] if single else first.get(len(columns), 1)
        while True:
            if at + width >= len(used):
                used.extend(bytes(len(used)))
            if at not in taken and not any(used[at + c] for c in columns):
                break
            at += 1
        if single:
            free = at + columns[0] + 1
        else:
            first[len(columns)] = at
        place[row] = at
        taken.add(at)
        for c in columns:
            used[at + c] = 1
    cells = np.full(int(place.max(initial=0)) + width + 1, -1, np.int64)
    for row, values in enumerate(rows):
        for c, v in values.items():
            cells[place[row] + c] = place[row] << 32 | place[v]
    return place, cells


class CrossParser:
    """The transitions of all languages, and the parsing of texts with them. A state is its row's place;
    0 stands for no open phrase, and for a phrase that nothing can continue."""

    def __init__(self, samples: dict[str, list[int]]):
        self.langs = sorted(samples)
        self.letters = np.array(sorted({c for s in samples.values() for c in s}), np.int64)
        self.width = len(self.letters) + 1  # the last code: letters never seen
        rows: list[dict[int, int]] = [{}]
        starts = []
        for lang in self.langs:
            root = len(rows)
            rows += [{c: root + s for c, s in to.items()} for to in suffix_automaton(self.coded(np.array(samples[lang], np.int64)).tolist())]
            starts.append([rows[root].get(c, 0) for c in range(self.width)])
            rows[root] = {}   # nothing leads to the start
        place, self.cells = displaced(rows, self.width)
        # the state after the first letter of a phrase; a letter that no phrase begins with is one of its own
        self.start = place[np.array(starts, np.int64).reshape(len(starts), self.width)]
        self.bits = np.array([math.log2(max(2, len(samples[x]))) for x in self.langs])

    def coded(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.letters, codes)
        known = self.letters[np.minimum(at, len(self.letters) - 1)] == codes if len(self.letters) else np.zeros(len(codes), bool)
        return np.where(known, at, len(self.letters)).astype(np.min_scalar_type(self.width))

    def phrases(self, codes: list[np.ndarray]) -> np.ndarray:
        """The number of greedy phrases of each text for each language: an array (languages, texts)."""
        return self.phrases_coded([self.coded(c) for c in codes])

    def phrases_coded(self, codes: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(c) for c in codes], np.int64)
        order = np.argsort(-sizes, kind="stable")
        fitted = np.zeros((len(self.langs), len(codes)), np.int32)  # letters that continue a phrase
        if not len(codes) or not self.langs or not sizes.max():
            return fitted
        flat = np.concatenate([codes[i] for i in order])
        at = np.cumsum(sizes[order]) - sizes[order]
        active = np.searchsorted(-sizes[order], -np.arange(sizes.max()), "left")  # texts longer than t
        state = np.zeros((len(self.langs), len(codes)), np.int64)
        wide = len(codes)
        for k in active.tolist():
            if k < wide:
                state, at, wide = state[:, :k].copy(), at[:k], k
            letter = flat[at]
            cell = self.cells.take(state + letter)
            fits = cell >> 32 == state
            fitted[:, :k] += fits
            state = np.where(fits, cell & 0xFFFFFFFF, self.start.take(letter, axis=1))
            at = at + 1
        out = np.empty_like(fitted)
        out[:, order] = sizes[order] - fitted   # each other letter begins a phrase
        return out

    def rates(self, codes: list[np.ndarray]) -> np.ndarray:
        """Normalised phrases of each text for each language: an array (texts, languages)."""
        return self.rates_coded([self.coded(c) for c in codes])

    def rates_coded(self, codes: list[np.ndarray]) -> np.ndarray:
        return self.phrases_coded(codes).T * self.bits / np.maximum(1, np.array([len(c) for c in codes]))[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        # a text's code points go as soon as it is coded: a byte a letter stays (two where scripts are large)
        codes, lettered = [], []
        for t in texts:
            points = code_points(t or "")
            codes.append(self.coded(points))
            lettered.append(bool(points.any()))
        rates = self.rates_coded(codes)
        langs, scores = [], []
        for some, r in zip(lettered, rates, strict=True):
            if not self.langs or not some:
                langs.append("und")
                scores.append(0.0)
                continue
            best = int(r.argmin())
            langs.append(self.langs[best])
            scores.append(float(1 / np.exp(SHARPNESS * np.minimum(0, r[best] - r)).sum()))
        return langs, scores


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", rows: int = TRAIN_ROWS,
          row_letters: int = ROW_LETTERS, letters: int = TRAIN_LETTERS) -> CrossParser:
    """The automata from at most ``rows`` labelled rows a language; only these rows come to the driver."""
    cut = F.substring(F.col(text), 1, 4 * row_letters)
    named = labelled.select(F.col(doc_id).cast("string").alias("id"), F.col(lang).cast("string").alias("lang"),
                            cut.alias("text"), F.xxhash64(cut).alias("text_hash")).where("lang is not null and lang <> 'und' and text is not null")
    # in two steps: a language that holds most rows is ranked in 64 parts first
    keys = named.select(F.xxhash64("id").alias("h"), "id", "lang", "text_hash").withColumn("_part", F.pmod("h", F.lit(64)))
    order = [F.col("h"), F.col("id"), F.col("text_hash")]
    for by in (["lang", "_part"], ["lang"]):
        keys = keys.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= rows)
    # written, so that the planner knows the size of these few rows when it chooses how to join them
    chosen = saved(keys.groupBy("id", "lang", "text_hash").agg(F.min("_n").alias("_n")), "sample")
    same = named["id"].eqNullSafe(chosen["id"]) & (named["lang"] == chosen["lang"]) & (named["text_hash"] == chosen["text_hash"])
    some = named.join(chosen, same).select(named["lang"], "_n", "text").distinct().orderBy("lang", "_n", "text").collect()
    discard(chosen)
    samples: dict[str, list[int]] = {}
    for r in some:
        got = samples.setdefault(r["lang"], [])
        got += code_points(r["text"])[:min(row_letters, letters - len(got))].tolist() + [0]
    return CrossParser({k: v for k, v in samples.items() if any(v)})


def together(texts: list[str], most: int) -> Iterator[list[str]]:
    """The texts in order, in lists of at most ``most`` characters (or one longer text)."""
    some: list[str] = []
    size = 0
    for t in texts:
        if some and size + len(t or "") > most:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t or "")
    if some:
        yield some


def with_language(docs: DataFrame, model: CrossParser, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs`` and the language and the score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            langs, scores = [], []
            for some in together(texts.tolist(), TOGETHER):
                got = shared.value.predict(some)
                langs += got[0]
                scores += got[1]
            yield pd.DataFrame({"lang": langs, "score": scores})

    return docs.withColumn("_judged", judge(F.col(text))).withColumns(
        {out: F.col("_judged.lang"), score: F.col("_judged.score")}).drop("_judged")


def op7_query(docs: DataFrame) -> DataFrame:
    rest = held_out(F.col("doc_id"), 4, 2)
    model = learn(docs.where(~rest))
    rows = with_language(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")

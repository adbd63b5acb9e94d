"""Source divergence audit: what the sources of a language say more often than each other.

Terms are counted per document, added up per (lang, source) inside each task and then once more
per key, so a source or a term that holds a third of all rows leaves a row per task. The terms
that at least ``MIN_DOCS`` documents of their language hold are numbered per language in blocks
of about ``BLOCK`` terms. A pair task co-groups the sorted (term id, count) arrays that two
sources have of one block, finds the common ids by galloping and prices common and one-sided
terms both ways; terms that neither source has all cost the same and are priced from their
number when the blocks are added up. A task never holds more than two blocks.

Defined results: null text, lang and source are empty strings; a text without letters still makes
its group occur; repeated rows count as documents of their own; a language without kept terms
has pairs of value 0 and no term rows; ties are ranked by the item's UTF-8 bytes; an empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentio.llm.common import saved

MIN_DOCS = 3          # a term is kept if so many documents of its language hold it
TOP_TERMS = 200       # rows of part `term` per group
BLOCK = 65_536        # term ids per block, on average
SALTS = 64            # copies of a language's size, so that its terms are joined in as many tasks
HELD_TERMS = 400_000  # (group, term) entries a task holds before it hands them on
SLICE = 1 << 20       # bytes of a text that are split at once
UNIT = 1_000_000_000  # prices are parts of this

# Letters are A-Z, a-z and every byte of a non-ASCII character; A-Z become a-z, the rest blanks.
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded number at a time."""
    text = text.translate(_LETTERS)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + SLICE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            cols = [pa.array([lang] * (len(terms) + 1), pa.string()), pa.array([source] * (len(terms) + 1), pa.string()),
                    pa.array([None, *terms], pa.binary()).cast(pa.string()),  # the row without a term says that the group occurs
                    pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in terms)], pa.int64())]
            yield from pa.Table.from_arrays(cols, schema=schema).to_batches(10_000)
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source")), batch.column("text").cast(pa.binary()), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for words in _pieces(text.as_py()):
                n.update(words)
                seen.update(words)
            docs.update(seen)
        if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
            yield from out()
    yield from out()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; a null term for each group."""
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "lang", "source"))
    rows = docs.select(lang.alias("lang"), source.alias("source"), text.alias("text"))
    part = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def price_sql(n: str, total: str, terms: str) -> str:
    """1 + floor(UNIT * (n + 1) / (total + terms)) in whole numbers; null for an empty vocabulary."""
    return (f"1 + (CAST({UNIT} AS DECIMAL(10,0)) * CAST({n} + 1 AS DECIMAL(20,0))) "
            f"div nullif(CAST({total} + {terms} AS DECIMAL(20,0)), 0)")


def gain_sql(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS, block: int = BLOCK) -> DataFrame:
    """(lang, term, lang_n, block, id): terms of enough documents, numbered from 0 in each block."""
    kept = saved(counts.where("term is not null").groupBy("lang", "term")
                 .agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("_d")).where(F.col("_d") >= min_docs).drop("_d"), "terms")
    sizes = kept.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks"))
    # a language may have most terms: its size is looked up in SALTS copies
    sizes = sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    kept = kept.withColumn("_salt", F.pmod(F.xxhash64("term", F.lit(7)), F.lit(SALTS)).cast("int")).join(sizes, ["lang", "_salt"])
    kept = kept.withColumn("block", F.pmod(F.xxhash64("term"), F.col("_blocks")).cast("int")).drop("_blocks", "_salt")
    in_block = Window.partitionBy("lang", "block").orderBy("term")
    return kept.withColumn("id", (F.row_number().over(in_block) - 1).cast("int"))


def _price(n: np.ndarray, total: int) -> np.ndarray:
    """As ``price_sql``: UNIT * (n + 1) // total in three steps of 1000, so nothing leaves 64 bits."""
    rest, out = n.astype(np.int64) + 1, np.zeros(len(n), np.int64)
    for _ in range(3):
        out = out * 1000 + rest * 1000 // total
        rest = rest * 1000 % total
    return out + 1


def _gain(p, q):
    return (p - q) * (p - q) // q


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the common values of two ascending arrays. For each run of ``short`` the end of
    its range in ``long`` is found in doubling steps, and the run is searched in that range only."""
    mine, theirs, low = [], [], 0
    for at in range(0, len(short), 64):
        run = short[at:at + 64]
        step = 64
        while low + step < len(long) and long[low + step] < run[-1]:
            step *= 2
        span = long[low:low + step + 1]
        found = np.searchsorted(span, run)
        hit = np.flatnonzero(found < len(span))
        hit = hit[span[found[hit]] == run[hit]]
        mine.append(at + hit)
        theirs.append(low + found[hit])
        low += int(found[-1])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(mine), join(theirs)


def _pair(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """One block of one pair of sources: gains of the terms that either has, and their number."""
    flat = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy() if t.num_rows else np.zeros(0, np.int64)
    ids, ns = ({s: flat(t, c) for s, t in (("a", left), ("b", right))} for c in ("ids", "ns"))
    some = left if left.num_rows else right
    total = {s: some.column(f"{s}_total")[0].as_py() for s in "ab"}
    swap = len(ids["a"]) > len(ids["b"])
    at = gallop(ids["b"], ids["a"])[::-1] if swap else gallop(ids["a"], ids["b"])
    price = {s: _price(ns[s], total[s]) for s in "ab"}
    none = {s: int(_price(np.zeros(1, np.int64), total[s])[0]) for s in "ab"}
    p, q = price["a"][at[0]], price["b"][at[1]]
    only_a, only_b = np.delete(price["a"], at[0]), np.delete(price["b"], at[1])
    ab = _gain(p, q).sum() + _gain(only_a, none["b"]).sum() + _gain(none["a"], only_b).sum()
    ba = _gain(q, p).sum() + _gain(none["b"], only_a).sum() + _gain(only_b, none["a"]).sum()
    lang, a, b = (key[i].as_py() for i in range(3))
    return pa.table({"lang": [lang], "a": [a], "b": [b], "terms": [len(p) + len(only_a) + len(only_b)], "ab": [int(ab)], "ba": [int(ba)]})


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has the divergence from each other source of
    the language, part `term` the terms that the source has more often than its language."""
    counts = saved(term_counts(docs), "counts")
    kept = saved(kept_terms(counts, min_docs, block), "kept")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    rows = saved(counts.where("term is not null").drop("docs").join(kept, ["lang", "term"]), "rows")
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = saved(counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left")
                   .join(langs, "lang", "left").na.fill(0, ["total", "terms", "lang_total"]), "groups")

    # part `term`: a join of each count with its group's totals
    priced = rows.join(groups, ["lang", "source"]).selectExpr(
        "lang", "source", "term AS item", f"{price_sql('n', 'total', 'terms')} AS p", f"{price_sql('lang_n', 'lang_total', 'terms')} AS q")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (priced.where("p > q").selectExpr("lang", "source", "'term' AS part", "item", f"{gain_sql('p', 'q')} AS value")
             .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))

    # part `pair`: unordered pairs of sources; every source brings its arrays to each of its pairs
    side = lambda s: groups.select("lang", F.col("source").alias(s), F.col("total").alias(f"{s}_n"), "terms")
    pairs = (side("a").join(side("b").drop("terms"), "lang").where("a < b")
             .select("lang", "a", "b", "terms", (F.col("a_n") + F.col("terms")).alias("a_total"), (F.col("b_n") + F.col("terms")).alias("b_total")))
    arrays = (rows.groupBy("lang", "source", "block").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("_x"))
              .select("lang", "source", "block", F.col("_x.id").alias("ids"), F.col("_x.n").alias("ns")))
    arrays = saved(arrays, "arrays")
    task = ["lang", "a", "b", "block"]
    cols = [*task, "ids", "ns", "a_total", "b_total"]
    brought = lambda s: arrays.withColumnRenamed("source", s).join(pairs, ["lang", s]).select(*cols).toDF(*cols).groupBy(*task)
    gains = (brought("a").cogroup(brought("b"))
             .applyInArrow(_pair, "lang string, a string, b string, terms long, ab long, ba long")
             .groupBy("lang", "a", "b").agg(F.sum("terms").alias("_t"), F.sum("ab").alias("_ab"), F.sum("ba").alias("_ba")))
    whole = pairs.join(gains, ["lang", "a", "b"], "left").na.fill(0, ["_t", "_ab", "_ba"]).selectExpr(
        "*", f"{price_sql('0', 'a_total', '0')} AS _pa", f"{price_sql('0', 'b_total', '0')} AS _pb").selectExpr(
        "lang", "a", "b",
        f"coalesce(_ab + (terms - _t) * ({gain_sql('_pa', '_pb')}), 0) AS ab", f"coalesce(_ba + (terms - _t) * ({gain_sql('_pb', '_pa')}), 0) AS ba")
    both = whole.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("ab").alias("value")),
                                                  F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("ba").alias("value")))).alias("_x"))
    both = both.select("lang", "_x.source", F.lit("pair").alias("part"), "_x.item", "_x.value").withColumn("rank", F.row_number().over(order))
    return both.unionByName(terms)


def op13_query(docs: DataFrame) -> DataFrame:
    return divergence(docs)


ORACLE_SQL = f"""WITH d AS (
SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
       regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS found
FROM documents),
w AS (SELECT r, lang, source, translate(unnest(found), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
langs AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
grid AS (
SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, l.v, 1 + {UNIT} * (k.n + 1) // (l.total + l.v) AS q
FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang
LEFT JOIN (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM w GROUP BY ALL) c
  ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
priced AS (SELECT *, 1 + {UNIT} * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p FROM grid),
found AS (
SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(s.value, 0) AS value
FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source
LEFT JOIN (SELECT a.lang, a.source, b.source AS other, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
           FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s
  ON s.lang = g.lang AND s.source = g.source AND s.other = o.source
UNION ALL
SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM priced WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}"""

"""N-gram Jaccard join by universe partition (pigeonhole), verified exactly.

A document's set holds its distinct word n-grams. Two sets of sizes a and b with Jaccard
similarity >= P % differ in at most H = floor((100 - P)(a + b) / (100 + P)) elements. Sizes fall into
bands; a set also takes part in the band below where it can have partners. In a band the
universe is hashed into m segments, more than the H of any pair there, so two similar sets
agree in at least m - H segments.

* Exact segments: a signature per non-empty segment. Each set leaves out as many of its
  signatures as m - H - 1 allows, the most frequent first (counted over all sets; both sides leave
  out by the same order, so an agreeing one always stays). A set with more empty segments than
  that also signs the empty ones.
* One-deletion segments: half as many segments, each signed whole and with every single element
  deleted; two similar sets have a segment that differs by one element at most. A band uses this
  form where its cost (signatures) is below that of the exact form (signatures, and a
  penalty for sets that run out of spare segments).

Equal sets are one class, and the join is between classes. In a bucket of equal signatures
every class is first compared with one centre (a star, never all pairs): the class whose
signatures are the most frequent, which in a group of near copies is the text they derive from.
The links so far give components; only classes of a bucket that are still in different
components are then compared with each other, each pair at its smallest common signature where that is among
the FIRST smallest of both, and only if it can have the m - H common segments that a link
implies (counted on 16-bit forms of the signatures, which never count too few). So no link between components is lost, and a large group of near
copies costs its size, not the square.

Defined results: null texts and texts without words have the empty set and no link; a text with
fewer than n words has one element, its whole word sequence; repeated rows are linked through
their class; a null doc_id never names a component unless all its members are null; an empty
table gives an empty result; other columns are not read. Elements are 64-bit hashes; should two
different sets share their class hash (told by a second hash), the join raises.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentio.llm.common import ascii_lower, discard, saved, words
from retentio.llm.op6_urls import components

BAND_RATIO = 1.5
SPARE = 2.0           # segments of the exact form over what the pigeonhole needs
FIRST = 8             # smallest signatures that a class carries to have a pair made once
SHORT_COST = 1000.0   # signatures that a set without spare segments is counted as


def with_shingles(docs: DataFrame, n: int, text: Column, out: str) -> DataFrame:
    """Add ``out``: the sorted distinct 64-bit hashes of the word n-grams of the whole text."""
    w = f"_{out}_w"
    docs = docs.withColumn(w, F.transform(words(ascii_lower(text)), lambda x: F.xxhash64(x)))
    size = F.size(w)
    grams = F.transform(F.sequence(F.lit(0), size - F.lit(n)), lambda i: F.xxhash64(*[F.get(F.col(w), i + F.lit(j)) for j in range(n)]))
    found = (F.when(size == 0, F.array().cast("array<bigint>")).when(size < n, F.array(F.xxhash64(F.col(w))))
             .otherwise(F.sort_array(F.array_distinct(grams))))
    return docs.withColumn(out, found).drop(w)


class Bands:
    """The size bands with their segment counts for a similarity of ``percent``."""

    def __init__(self, percent: int, largest: int):
        self.p = percent
        self.lo, self.hi, self.m, self.deletes = [], [], [], []
        lo = 1
        while lo <= largest:
            hi = max(int(lo * BAND_RATIO), lo * 100 // percent)
            h = self.differ(hi, hi * 100 // percent)
            exact = math.ceil(SPARE * (h + 1)) + (h > 0)
            half = -(-(h + 1) // 2)
            empty = exact * math.exp(-lo / exact)  # expected empty segments of the band's smallest sets
            spare = exact - 1 - self.differ(lo, lo * 100 // percent)
            # chance that such a set has more empty segments than it can spare (Poisson)
            short = 1 - sum(math.exp(i * math.log(empty) - empty - math.lgamma(i + 1)) for i in range(spare + 1)) if empty > 0 else 0.0
            deletes = h > 0 and hi + half < exact + SHORT_COST * max(0.0, short)
            self.lo.append(lo)
            self.hi.append(hi)
            self.m.append(half if deletes else exact)
            self.deletes.append(deletes)
            lo = hi + 1

    def differ(self, a: int, b: int) -> int:
        return (100 - self.p) * (a + b) // (100 + self.p)

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.lo, size, "right")) - 1

    def roles(self, size: int) -> list[tuple[int, int]]:
        """(band, most elements that a partner there differs in): the own band and the one below."""
        b = self.of(size)
        out = [(b, self.differ(size, size * 100 // self.p))]
        if b and self.hi[b - 1] * 100 >= size * self.p:
            out.append((b - 1, self.differ(size, min(size, self.hi[b - 1]))))
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(tokens: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of a set (the lowest bit tells odd from even bands) and with each of them how
    many frequent signatures of its band the set may leave out."""
    out, spare = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    tokens = tokens.astype(np.int64).view(np.uint64)
    value = _mix(tokens)
    for b, h in bands.roles(len(tokens)) if len(tokens) else ():
        m = bands.m[b]
        seg = (tokens % np.uint64(m)).astype(np.int64)
        total = np.zeros(m, np.uint64)
        np.add.at(total, seg, value)
        salt = _mix((np.arange(m, dtype=np.uint64) << np.uint64(20)) + np.uint64(b + 1))
        if bands.deletes[b]:
            sig = np.concatenate([_mix(total ^ salt), _mix((total[seg] - value) ^ salt[seg])])
            free = 0
        else:
            size = np.bincount(seg, minlength=m)
            empty = int((size == 0).sum())
            sig = _mix(total ^ salt)
            if empty <= m - 1 - h:
                sig = sig[size > 0]
            free = max(0, m - 1 - h - empty)
        sig = np.unique((sig & ~np.uint64(1)) | np.uint64(b & 1))
        out.append(sig)
        spare.append(np.full(len(sig), free, np.int32))
    return np.concatenate(out).view(np.int64), np.concatenate(spare)


def _key(first: Column, second: Column, drawn: list[list[int]]) -> Column:
    """The class key: the first hash, drawn anew from both where different sets shared it."""
    key = first
    for i, taken in enumerate(drawn):
        key = F.when(key.isin(taken), F.xxhash64(F.lit(i), first, second)).otherwise(key)
    return key


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text",
                       class_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, text_hash, n_shingles, class_id, component_id) of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    grams = with_shingles(rows, n, F.col("text"), "grams")
    first, second = class_hash(F.col("grams")), F.xxhash64(F.lit("second"), "grams")
    drawn: list[list[int]] = []       # per round, the keys that different sets shared
    while True:
        sets = saved(grams.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"), F.size("grams").cast("long").alias("n"),
                                  _key(first, second, drawn).alias("node"), second.alias("check")), "sets")
        classes = saved(sets.where("n > 0").groupBy("node").agg(
            F.min("check").alias("c0"), F.max("check").alias("c1"), F.min("doc_id").alias("first"), F.max("n").alias("n")), "classes")
        shared_keys = [r["node"] for r in classes.where("c0 <> c1").select("node").collect()]
        if not shared_keys:
            break
        drawn.append(shared_keys)
        discard(sets, classes)
    bands = Bands(percent, max(1, classes.agg(F.max("n")).first()[0] or 0))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 500):  # a few texts at a time
                nodes = b["node"].to_numpy()[lo:lo + 500]
                made = [signatures(np.asarray(g), bands) for g in b["grams"].iloc[lo:lo + 500]]
                yield pd.DataFrame({"sig": np.concatenate([m[0] for m in made]), "node": np.repeat(nodes, [len(m[0]) for m in made]),
                                    "spare": np.concatenate([m[1] for m in made])})

    # the grams are computed again rather than kept: they are larger than the texts
    entries = grams.select(_key(first, second, drawn).alias("node"), "grams").mapInPandas(sign, "sig long, node long, spare int")
    # buckets with more than one class; a hot bucket is sorted, not held
    bucket = Window.partitionBy("sig")
    shared = entries.withColumns({"lo": F.min("node").over(bucket), "hi": F.max("node").over(bucket), "often": F.count("*").over(bucket)})
    shared = saved(shared.where("lo <> hi").select("sig", "node", "spare", "often").distinct(), "shared")
    # the lowest bit of a signature tells which of a class's two bands it belongs to
    order = Window.partitionBy("node", F.col("sig").bitwiseAND(F.lit(1))).orderBy(F.col("often").desc(), "sig")
    kept = shared.withColumns({"_rank": F.row_number().over(order), "weight": F.sum("often").over(Window.partitionBy("node"))})
    kept = saved(kept.where(F.col("_rank") > F.col("spare")).select("sig", "node", "spare", "weight"), "kept")
    # first each class against the centre of its bucket
    centre = kept.groupBy("sig").agg(F.max(F.struct("weight", "node")).alias("c"), F.count("*").alias("f")).where("f > 1")
    star = (kept.join(centre.select("sig", F.col("c.node").alias("a")), "sig").where("node <> a")
            .select("a", F.col("node").alias("b")).distinct())
    grams = saved(_grams_of(docs, sets, kept, n, doc_id, text), "grams")
    links = saved(verified(star, grams, percent), "links")
    label = components(links)
    # then the classes of a bucket that are in different components
    placed = kept.select("sig", "node").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    spread = Window.partitionBy("sig")
    placed = saved(placed.withColumns({"c0": F.min("component").over(spread), "c1": F.max("component").over(spread)})
                   .where("c0 <> c1").drop("c0", "c1"), "placed")
    extra = saved(verified(_across(placed, kept, shared, classes, bands), grams, percent), "extra")
    discard(shared, kept, placed, grams)
    if not extra.isEmpty():
        label = components(links.unionByName(extra))
    discard(links, extra)
    named = label.join(classes.select("node", "first"), "node")
    smallest = named.groupBy("component").agg(F.min("first").alias("name"))
    named = named.join(smallest, "component").select("node", "name")
    whole = classes.select("node", "first").join(named, "node", "left").select("node", F.coalesce("name", "first").alias("name"))
    out = sets.select("doc_id", "text_hash", "n", "node").join(whole, "node", "left")
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("node").alias("class_id"),
                      F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("doc_id")).alias("component_id"))


def _across(placed: DataFrame, kept: DataFrame, shared: DataFrame, classes: DataFrame, bands: Bands) -> DataFrame:
    """(a, b): classes of a bucket in different components whose sizes and common segments allow
    a link. A pair is looked for in the lower of the two classes' bands only, and the lowest bit
    of a signature tells a class's two bands apart; so a row carries of its own band alone the smallest
    signatures (a pair that has one of them in common is made at the smallest only), the 16-bit
    forms of all, how many of them fell together, and how many the class may leave out."""
    odd = F.col("sig").bitwiseAND(F.lit(1)).alias("odd")
    nodes = placed.select("node", odd).distinct()
    small = Window.partitionBy("node", "odd").orderBy("sig")
    first = (kept.withColumn("odd", odd).join(nodes, ["node", "odd"]).withColumn("_n", F.row_number().over(small)).where(F.col("_n") <= FIRST)
             .groupBy("node", "odd").agg(F.collect_list("sig").alias("k")))
    short = F.shiftright("sig", 1).bitwiseAND(F.lit(0xFFFF)).cast("int") - 32768
    forms = (shared.withColumn("odd", odd).join(nodes, ["node", "odd"]).groupBy("node", "odd")
             .agg(F.collect_set(short.cast("smallint")).alias("t"), (F.count("*") - F.size(F.collect_set(short.cast("smallint")))).alias("fell"),
                  F.max("spare").alias("s")))
    band = F.size(F.filter(F.array(*[F.lit(x) for x in bands.lo]), lambda x: x <= F.col("n"))) - 1
    info = first.join(forms, ["node", "odd"]).join(classes.select("node", "n"), "node").withColumn("band", band)
    full = placed.select("sig", "node", "component", odd).join(info, ["node", "odd"])
    x, y = full.alias("x"), full.alias("y")
    low = F.least("x.band", "y.band")
    m, hi = [F.get(F.array(*[F.lit(v) for v in vs]), low) for vs in (bands.m, bands.hi)]
    deletes = F.get(F.array(*[F.lit(v) for v in bands.deletes]), low)
    p = bands.p

    def differ(a: Column, b: Column) -> Column:
        return F.floor((100 - p) * (a + b) / (100 + p))

    def empty(t: str) -> Column:
        """At most so many empty segments has the class not signed."""
        n = F.col(f"{t}.n")
        h = F.when(F.col(f"{t}.band") == low, differ(n, F.floor(n * 100 / p))).otherwise(differ(n, F.least(n, hi)))
        return m - 1 - h - F.col(f"{t}.s")

    need = m - differ(F.col("x.n"), F.col("y.n")) - F.least(empty("x"), empty("y")) - F.greatest("x.fell", "y.fell")
    enough = deletes | (F.size(F.array_intersect("x.t", "y.t")) >= need)
    earlier = F.exists(F.array_intersect("x.k", "y.k"), lambda v: v < F.col("x.sig"))
    cond = ((F.col("x.sig") == F.col("y.sig")) & (low % 2 == F.col("x.odd")) & (F.col("x.node") < F.col("y.node"))
            & (F.col("x.component") != F.col("y.component")) & (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * p) & ~earlier & enough)
    return x.join(y, cond).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _grams_of(docs: DataFrame, sets: DataFrame, shared: DataFrame, n: int, doc_id: str, text: str) -> DataFrame:
    """(node, grams) of the classes that share a bucket: the sets again, of one text a class."""
    wanted = shared.select("node").distinct()
    one = sets.join(wanted, "node").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("_k"))
    rows = docs.select(F.col(doc_id).alias("_d"), F.col(text).cast("string").alias("_t")).withColumn("_h", F.xxhash64(F.coalesce(F.col("_t"), F.lit(""))))
    rows = rows.join(one, (F.col("_h") == F.col("_k.text_hash")) & F.col("_d").eqNullSafe(F.col("_k.doc_id"))).select("node", "_t")
    return with_shingles(rows, n, F.col("_t"), "grams").select("node", "grams").dropDuplicates(["node"])


def verified(pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` with 100 * intersection >= percent * union. First on 16-bit forms of the
    elements, a quarter of their size: two sets have at most the common forms, and as many more as
    fell together in one of them, in common. What that leaves is then held against the sets themselves."""
    forms = F.array_distinct(F.transform("grams", lambda g: (g.bitwiseAND(F.lit(0xFFFF)) - 32768).cast("smallint")))
    short = grams.select("node", F.size("grams").alias("n"), forms.alias("t"))
    x, y = [short.select(F.col("node").alias(c), F.col("n").alias(f"{c}n"), F.col("t").alias(f"{c}t")) for c in "ab"]

    def enough(common: Column, a: Column, b: Column) -> Column:
        return 100 * common >= percent * (a + b - common)

    fell = F.least(F.col("an") - F.size("at"), F.col("bn") - F.size("bt"))
    likely = (pairs.join(short.select(F.col("node").alias("b"), F.col("n").alias("_n")), "b")
              .join(x, "a").where(enough(F.least("an", "_n"), F.col("an"), F.col("_n"))).drop("_n")
              .join(y, "b").where(enough(F.size(F.array_intersect("at", "bt")) + fell, F.col("an"), F.col("bn"))).select("a", "b"))
    a, b = grams.select(F.col("node").alias("a"), F.col("grams").alias("_x")), grams.select(F.col("node").alias("b"), F.col("grams").alias("_y"))
    both = F.size(F.array_intersect("_x", "_y"))
    return likely.join(a, "a").join(b, "b").where(enough(both, F.size("_x"), F.size("_y"))).select("a", "b")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of every component (the smallest doc_id; of equal ones the smallest text hash), and
    every row without words; the columns of ``docs``."""
    comps = jaccard_components(docs, n, percent)
    key = F.struct("doc_id", "text_hash")
    # copies first: a class gives its smallest row, then a component
    by_class = comps.where("n_shingles > 0").groupBy("component_id", "class_id").agg(F.min(key).alias("k"))
    first = by_class.groupBy("component_id").agg(F.min("k").alias("k")).select(F.col("k.doc_id").alias("_d"), F.col("k.text_hash").alias("_h"))
    rows = docs.withColumn("_hash", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    wordless = F.size(words(F.col("text"))) == 0
    kept = rows.where(~wordless).join(first, (F.col("_hash") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    again = Window.partitionBy("_hash", "doc_id").orderBy(F.lit(0))  # rows that differ in neither: any of them
    kept = kept.withColumn("_n", F.row_number().over(again)).where("_n = 1")
    return kept.select(*docs.columns).unionByName(rows.where(wordless).select(*docs.columns))


def op3_query(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs, 4, 85).select("doc_id", "n_shingles", "component_id")


# Shared shingles are counted for pairs whose sizes allow a link; components are the closure over the links.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM w
), n AS (
  SELECT doc_id, len(s)::BIGINT AS n_shingles, unnest(s) AS g FROM s
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared, any_value(a.n_shingles) AS nx, any_value(b.n_shingles) AS ny
  FROM n a JOIN n b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n_shingles, b.n_shingles) >= 85 * greatest(a.n_shingles, b.n_shingles) GROUP BY ALL
), links AS (
  SELECT x, y FROM common WHERE 100 * shared >= 85 * (nx + ny - shared)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, e.y FROM reach r JOIN edges e ON r.b = e.x
), least AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least.component_id
FROM s JOIN least ON least.a = s.doc_id
"""

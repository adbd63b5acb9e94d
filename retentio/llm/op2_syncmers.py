"""Document fingerprints from closed syncmers (DataFrame functions only).

A document is a sequence of lower-cased words. Of its k-word windows (k-mers) those are
anchors whose minimal inner s-word substring (by hash) is the first or the last one: a
property of the k-mer alone, so the same words give the same anchors wherever they stand,
and an edit only touches the anchors that overlap it. The fingerprint lists the anchors'
32-bit hashes in order of their place.

Texts of fewer than ``FEW_WORDS`` words (short ones, and those without blanks of any length) are sequences
of code points instead, their words joined by one blank each. Texts of fewer than twice as many
words have the anchors of both, so that texts on either side of a bound can still be alike.

Defined results: null text counts as empty; an empty text has the empty fingerprint; a text
with fewer than k code points has one anchor, all of it; where no k-mer qualifies, the k-mer
with the smallest hash is the anchor. Long texts are taken whole. Repeated rows are kept and
ordered by (doc_id descending, nulls last; text). Columns other than the id and the text are
not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentio.llm.common import sliced

K, S = 6, 2
FEW_WORDS = 24  # below, anchors are of code points; from here to twice as many words, of both


def _syncmers(df: DataFrame, units: str, out: str, k: int, s: int) -> DataFrame:
    """Add ``out``: array<int> of closed-syncmer anchors of the hashed ``units``, in order."""
    m, c = f"_{out}_m", f"_{out}_c"
    spans = k - s + 1  # inner substrings of a k-mer
    n = F.size(units)

    def at(arr: str, i: Column, step: int) -> Column:
        return F.get(F.col(arr), i + F.lit(step))

    def kmer(i: Column) -> Column:
        # inner substrings at distance s, and the last one: together they hold all k units
        places = sorted({*range(0, spans, s), spans - 1})
        return F.hash(*[at(m, i, p) for p in places])

    places = F.when(n >= k, F.sequence(F.lit(0), n - F.lit(k))).otherwise(F.array().cast("array<int>"))
    chosen = F.filter(places, lambda i: F.least(*[at(m, i, j) for j in range(spans)]).isin(at(m, i, 0), at(m, i, spans - 1)))
    df = df.withColumn(m, F.when(n >= s, F.transform(F.sequence(F.lit(0), n - F.lit(s)),
                                                     lambda i: F.xxhash64(*[at(units, i, j) for j in range(s)]))))
    df = df.withColumn(c, chosen)
    found = F.transform(F.col(c), kmer)
    few = F.when(n == 0, F.array().cast("array<int>")).when(n < k, F.array(F.hash(F.col(units)))).otherwise(
        F.array(F.array_min(F.transform(places, kmer))))
    return df.withColumn(out, F.when(F.size(c) > 0, found).otherwise(few)).drop(m, c)


def with_anchors(df: DataFrame, text: str, out: str, k: int = K, s: int = S) -> DataFrame:
    """Add ``out``: array<int> of closed-syncmer anchors of column ``text`` in text order, those of words before
    those of code points where a text has both."""
    w, h, p = f"_{out}_w", f"_{out}_h", f"_{out}_p"
    none = F.array().cast("array<bigint>")
    df = df.withColumn(w, F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "\\s+"), lambda x: x != ""))
    n = F.size(w)
    points = F.filter(F.split(F.array_join(w, " "), ""), lambda x: x != "")
    df = df.withColumns({h: F.when(n >= FEW_WORDS, F.transform(F.col(w), lambda x: F.xxhash64(x))).otherwise(none),
                         p: F.when(n < 2 * FEW_WORDS, F.transform(points, lambda x: F.xxhash64(x))).otherwise(none)}).drop(w)
    df = _syncmers(_syncmers(df, h, f"_{out}_by_word", k, s), p, f"_{out}_by_point", k, s)
    return df.withColumn(out, F.concat(f"_{out}_by_word", f"_{out}_by_point")).drop(h, p, f"_{out}_by_word", f"_{out}_by_point")


def fingerprint_text(anchors: Column) -> Column:
    """The anchors as one string: 8 hex digits each, in order, separated by blanks."""
    return F.array_join(F.transform(anchors, lambda a: F.lower(F.lpad(F.hex(a.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of the two anchor sets, 0 to 1; two empty fingerprints: 1."""
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def whole_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text), null texts as empty ones; no other column is read."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, s: int = S) -> DataFrame:
    """(doc_id, text, anchors): closed-syncmer anchors of every whole text."""
    return with_anchors(whole_texts(docs, doc_id, text), "text", "anchors", k, s)


def with_next(texts: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """(doc_id, text) with anchors, next_text, next_anchors: of the next document in descending doc_id, the first after
    the last. Rows are dealt to slices of the id range; a window finds the neighbour inside a
    slice, and the last row of a slice takes the first row of the next slice that has rows."""
    dealt = sliced(texts, "doc_id", "_slice")
    rows = with_anchors(dealt, "text", "anchors", k, s)
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    w = Window.partitionBy("_slice").orderBy(*order)
    # plain columns: a struct made for the window would be shuffled beside them
    inside = rows.withColumns({"_text": F.lead("text").over(w), "_anchors": F.lead("anchors").over(w)})
    # slice numbers only: a row per slice (bounded by the number of slices)
    seq = Window.orderBy(F.col("_slice").desc())
    heads = dealt.select("_slice").distinct()
    follow = heads.select(F.col("_slice").alias("_of"), F.coalesce(F.lead("_slice").over(seq), F.max("_slice").over(
        Window.partitionBy())).alias("_follow"))
    # a row per slice, as many as the bounds that the driver holds: bounded, so broadcast
    keys = dealt.groupBy(F.col("_slice").alias("_follow")).agg(
        F.max("doc_id").alias("_id"))  # null only in the slice of null ids
    firsts = (texts.join(F.broadcast(keys), F.col("doc_id").eqNullSafe(F.col("_id")))
              .groupBy("_follow").agg(F.min("text").alias("text")))
    edge = with_anchors(follow.join(firsts, "_follow"), "text", "anchors", k, s).select("_of", F.col("text").alias("_t"), F.col("anchors").alias("_a"))
    return (inside.join(edge, F.col("_text").isNull() & (F.col("_slice") == F.col("_of")), "left")
            .select("doc_id", "text", "anchors", F.coalesce("_text", "_t").alias("next_text"), F.coalesce("_anchors", "_a").alias("next_anchors")))


def edited_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text: the last floor(n/3) code points
    give way to the first as many (or all) of the next document's."""
    rows = with_next(whole_texts(docs, doc_id, text))
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)))
    return with_anchors(rows, "edited", "edited_anchors")


def op2_query(docs: DataFrame) -> DataFrame:
    rows = edited_pairs(docs)
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint_text(F.col("anchors")).alias("fingerprint"),
        fingerprint_text(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"))

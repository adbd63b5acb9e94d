"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a target number of words. Complete epochs over a source come first; what
is left of the target is filled by a weighted sample without replacement: documents in
ascending order of the exponential key -ln(u) / quality, where u is a fixed hash of the
document, taken until the prefix sum of their sizes reaches the budget.

Defined results: null and empty texts have size 0 and take 0; a null source is a source of
its own, last in the order; a null or non-positive quality counts as 1; repeated rows are
rows of their own (their keys differ by a repeat number); an empty table gives an empty
result. Equal keys are ordered by doc_id, text hash and repeat number, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentio.llm.common import running_sum, shuffle_parts, words

WEIGHTS = (5, 2, 1)   # of the sources in order, repeating
SHARE = 1.5           # of all sizes that the mix takes
MAX_EPOCHS = 2        # times its size that a source (and a document) gives at most
SEED = "mix-1"


def source_targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> with target. Water filling in closed form: in ascending order of
    cap * size / weight the first sources are held at their cap; the others share what is left
    by weight. The windows run over one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    every = Window.partitionBy()
    ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    t = totals.withColumn("_w", w).withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
    t = (t.withColumn("_budget", F.lit(float(share)) * F.sum("source_size").over(every))
         .withColumn("_left", F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
         .withColumn("_open", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    # a source is held at its cap as long as its fair share of what is left reaches the cap
    t = t.withColumn("_held", F.col("_left") * F.col("_w") >= F.col("_cap") * F.col("_open"))
    t = (t.withColumn("_fl", F.min(F.when(~F.col("_held"), F.struct(F.col("_cap") / F.col("_w"), F.col("_left"), F.col("_open")))).over(every))
         .withColumn("target", F.when(F.col("_held"), F.col("_cap")).otherwise(
             F.col("_w") * F.col("_fl._left") / F.col("_fl._open"))))
    return t.select("source", "source_size", "target")


def sample_key(doc_id: Column, text_hash: Column, repeat: Column, quality: Column, seed: str = SEED) -> Column:
    """-ln(u) / quality with u in (0, 1) from 52 bits of the md5 of seed, document and repeat."""
    name = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), text_hash.cast("string")), repeat.cast("string"))
    u = (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(2 ** 52)
    return -F.log(u) / F.when(quality > 0, quality).otherwise(F.lit(1.0))


def sized(docs: DataFrame) -> DataFrame:
    """Add _size (words of the whole text) and _hash (of the text), which ``mixed`` needs."""
    return (docs.withColumn("_size", F.size(words(F.col("text"))).cast("long"))
            .withColumn("_hash", F.xxhash64(F.coalesce(F.col("text"), F.lit("")))))


def mixed(rows: DataFrame, quality: Column | None = None, weights=WEIGHTS, share: float = SHARE,
          cap: float = MAX_EPOCHS, split_last: bool = True, seed: str = SEED) -> DataFrame:
    """All columns of ``rows`` (``sized`` documents with doc_id and source; the text itself is not
    read again) and _source_size, _target, _epochs (complete copies), _part (words of the
    fractional selection), _taken.

    With ``split_last`` the document on the budget's edge gives the words that are still missing;
    without, it is taken whole if that brings the source nearer to its target, else not at all.
    """
    keep = rows.columns
    totals = rows.groupBy("source").agg(F.sum("_size").alias("source_size"))
    rows = rows.withColumn("_q", (quality if quality is not None else F.lit(1.0)).cast("double"))
    # repeated rows: a number among equal ones
    again = Window.partitionBy("doc_id", "_hash").orderBy(F.col("source").asc_nulls_last())
    rows = rows.withColumn("_rep", F.row_number().over(again))
    rows = rows.withColumn("_key", sample_key(F.col("doc_id"), F.col("_hash"), F.col("_rep"), F.col("_q"), seed))
    plan = source_targets(totals, weights, share, cap).select(
        F.col("source").alias("_src"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    # 1 - exp(-key) is nearly even: it deals a source's keys to buckets in order
    n = 4 * shuffle_parts(rows.sparkSession)
    rows = rows.withColumn("_bucket", F.floor((1.0 - F.exp(-F.col("_key"))) * n).cast("long"))
    rows = running_sum(rows, ["source"], "_bucket", [F.col("_key"), F.col("doc_id").asc_nulls_last(), F.col("_hash"), F.col("_rep")], "_size", "_before")
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("_src")), "left")
    src, goal = F.col("_source_size"), F.col("_target")
    epochs = F.when(src > 0, F.floor(goal / src)).otherwise(0).cast("long")
    rest = F.floor(goal - epochs * src + 0.5).cast("long")
    room = F.least(F.col("_size"), F.greatest(F.lit(0), rest - F.col("_before")))
    part = room if split_last else F.when(room * 2 >= F.col("_size"), F.col("_size")).otherwise(F.lit(0))
    return (rows.withColumn("_epochs", epochs).withColumn("_part", part.cast("long"))
            .withColumn("_taken", F.col("_epochs") * F.col("_size") + F.col("_part"))
            .select(*keep, "_source_size", "_target", "_epochs", "_part", "_taken"))


def mix_documents(docs: DataFrame, quality: Column | None = None, **how) -> DataFrame:
    """The mix itself: each document's row repeated for every copy taken, whole documents only.
    A document without words costs nothing and is kept once. All columns but the text come back;
    pass the row along in a column of its own to get it whole."""
    rows = mixed(sized(docs).drop("text"), quality, split_last=False, **how)
    copies = F.when(F.col("_size") == 0, 1).otherwise(F.col("_epochs") + F.when(F.col("_part") > 0, 1).otherwise(0))
    return (rows.withColumn("_copies", copies.cast("int")).where("_copies > 0")
            .withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*[c for c in docs.columns if c != "text"]))


def op5_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality 1.0 for documents labelled good or not labelled, 0.5 for those labelled bad."""
    q = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_l")).agg(F.max("quality").alias("_quality"))
    rows = sized(docs.select("doc_id", "text", "source")).drop("text").join(q, F.col("doc_id") == F.col("_l"), "left")
    rows = mixed(rows, F.when(F.col("_quality") == 0, 0.5).otherwise(1.0))
    return rows.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                       F.col("_target").alias("target"), F.col("_taken").alias("taken"))

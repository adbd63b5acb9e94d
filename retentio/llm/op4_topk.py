"""Exact top-k under Hamming distance by incremental multi-index hashing.

A binary code of B bits is cut into m segments of about log2(number of codes) bits. Two codes at
distance d agree in some segment up to floor(d / m) bits, so after all segments have been searched
at radius r every code nearer than m * (r + 1) has been seen. Each round widens the radius by one
and ends the queries whose k-th verified distance is covered. With the first a segments searched at
radius r and the others at r - 1, every code nearer than m * r + a has been seen; so a query whose
k-th distance so far is d searches the first d - m * r + 1 segments only.

The index of a segment is cut into blocks by the upper half of the segment's bits, about the square
root of the number of codes each. A query visits the blocks that exist within r bits of its own upper
half and meets the segment values in them, so no value that no code has is ever made. A pair of codes
is found in the first of its nearest segments and nowhere else, hence once. A visit gives back at most
the k + 1 nearest rows, none beyond the query's k-th distance so far. A block of many codes or many
visits is cut into cells of at most about ``CELL`` codes and ``VISITS`` visits.

Rows with equal codes are one code: of each code the k + 1 smallest ids are kept (more cannot be
in an answer), so large groups of equal vectors cost no more than one. The code itself is the key.

Codes are the signs of the vector's numbers (1 where > 0). Defined results: a null or empty
vector has no code, is no query's neighbour and has no neighbours itself; null elements count as
0; vectors of another length than the longest are compared as if padded with 0 bits; ties go to
the smaller id; a row is not its own neighbour; repeated ids are one row of the first code.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentio.llm.common import discard, saved

K = 10
WORD = 63  # bits of a code kept in one long
CELL = 4096    # codes of a block that one task compares at once
VISITS = 4096  # visits that it compares them with


def sign_code(vector: Column, width: int) -> Column:
    """The signs of the first ``width`` numbers as an array of longs of ``WORD`` bits each."""
    def word(lo: int) -> Column:
        n = min(WORD, width - lo)
        return F.aggregate(F.sequence(F.lit(lo), F.lit(lo + n - 1)), F.lit(0).cast("long"),
                           lambda acc, i: acc * 2 + F.when(F.coalesce(F.get(vector, i), F.lit(0.0)) > 0, 1).otherwise(0))
    return F.array(*[word(lo) for lo in range(0, width, WORD)])


def _bits(code: Column, width: int, lo: int, n: int) -> Column:
    """Bits lo .. lo + n - 1 of a code as a number."""
    total = F.lit(0).cast("long")
    at, left = lo, n
    while left:
        w = at // WORD
        size = min(WORD, width - w * WORD)
        take = min(left, w * WORD + size - at)
        shift = size - (at - w * WORD) - take
        total = F.shiftleft(total, take) + F.shiftright(F.get(code, F.lit(w)), shift).bitwiseAND(F.lit((1 << take) - 1).cast("long"))
        at, left = at + take, left - take
    return total


def segments(width: int, codes: int) -> list[tuple[int, int]]:
    """(first bit, bits) of segments of nearly equal size, about log2 of the number of codes."""
    m = max(1, round(width / max(1.0, math.log2(max(2, codes)))), -(-width // 62))
    edges = [width * i // m for i in range(m + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)]


def _matrix(arrays: pd.Series) -> np.ndarray:
    return np.array(arrays.tolist(), np.int64)


def search_cell(visits: pd.DataFrame, cell: pd.DataFrame, seg: int, radius: int, k: int) -> pd.DataFrame:
    """The rows that a segment finds first, at exactly this radius: for each visit (code, kth) the k + 1
    nearest by (distance, id) among the ids of the cell's codes, none farther than kth."""
    out = [pd.DataFrame({"code": pd.Series([], dtype=object), "distance": np.zeros(0, np.int32), "id": np.zeros(0, np.int64)})]
    if len(visits) and len(cell):
        asked, codes, kth = _matrix(visits["code"]), _matrix(cell["code"]), visits["kth"].to_numpy()
        sizes = cell["ids"].map(len).to_numpy()
        ids, starts = np.concatenate(cell["ids"].tolist()), np.cumsum(sizes) - sizes
        step = max(1, 2_000_000 // codes.size)
        for at in range(0, len(asked), step):
            apart = np.bitwise_count(asked[at:at + step, None, :] ^ codes[None, :, :])
            distance = apart.sum(2, dtype=np.int64)
            hit = (apart[:, :, seg] == radius) & (apart.argmin(2) == seg) & (distance <= kth[at:at + step, None])
            q, c = np.nonzero(hit)
            n = sizes[c]
            which = np.repeat(starts[c], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            q, d, i = np.repeat(q, n), np.repeat(distance[q, c], n), ids[which]
            order = np.lexsort((i, d, q))
            q, d, i = q[order], d[order], i[order]
            near = np.arange(len(q)) - np.searchsorted(q, q) <= k
            if near.any():
                out.append(pd.DataFrame({"code": list(asked[at + q[near]]), "distance": d[near].astype(np.int32), "id": i[near]}))
    return pd.concat(out[1:]) if len(out) > 1 else out[0]


def _blocks(code: Column, cuts: list[tuple[int, int]]) -> Column:
    """For each segment its number, the bits below its upper half, and its upper half as a number."""
    return F.inline(F.array(*[F.struct(F.lit(i).alias("seg"), F.lit(size // 2).alias("upper"), F.lit(size - size // 2).alias("lower"),
                                       F.shiftright(F.get(code, F.lit(i)), size - size // 2).alias("block")) for i, (_, size) in enumerate(cuts)]))


def _visits(pending: DataFrame, cuts: list[tuple[int, int]], radius: int) -> DataFrame:
    """(code, kth, seg, block): the blocks that may hold a value at ``radius`` bits from a query's own."""
    needed = F.col("kth") - len(cuts) * radius >= F.col("seg")
    apart = lambda b: F.bit_count(b.bitwiseXOR(F.col("block")))
    near = F.filter(F.expr("sequence(0L, shiftleft(1L, upper) - 1)"), lambda b: (apart(b) <= radius) & (apart(b) + F.col("lower") >= radius))
    return pending.select("code", "kth", _blocks(F.col("code"), cuts)).where(needed).select("code", "kth", "seg", F.explode(near).alias("block"))


def _round(index: DataFrame, sizes: DataFrame, pending: DataFrame, cuts: list[tuple[int, int]], radius: int, k: int,
           cell: int, visits_max: int) -> DataFrame:
    """(code, distance, id): what the pending queries meet at ``radius``."""
    at = ["seg", "block"]
    visits = saved(_visits(pending, cuts, radius).join(sizes, at), "visits")
    load = (visits.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.first("codes").alias("codes"))
            .select(*at, F.ceil(F.col("codes") / cell).alias("chunks"), F.ceil(F.col("n") / visits_max).alias("parts")))
    load = saved(load, "load")
    asks = (visits.select("code", "kth", *at).join(load, at)
            .select("code", "kth", *at, F.pmod(F.xxhash64("code"), "parts").alias("part"), F.explode(F.expr("sequence(0L, chunks - 1)")).alias("chunk")))
    held = (index.join(load, at)
            .select("code", "ids", *at, F.pmod(F.xxhash64("code"), "chunks").alias("chunk"), F.explode(F.expr("sequence(0L, parts - 1)")).alias("part")))
    by = [*at, "chunk", "part"]

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return search_cell(left, right, int(key[0]), radius, k)

    met = asks.groupBy(*by).cogroup(held.groupBy(*by)).applyInPandas(search, "code array<long>, distance int, id long")
    met = saved(met, "met")
    discard(visits, load)
    return met


def top_k(rows: DataFrame, queries: Column, k: int = K, row_id: str = "vec_id", vector: str = "embedding",
          cell: int = CELL, visits: int = VISITS) -> DataFrame:
    """(query_id, rank, neighbour_id, distance): for the rows of which ``queries`` (a predicate on
    the id) holds, the k other rows with the smallest Hamming distance."""
    spark = rows.sparkSession
    width = rows.agg(F.max(F.size(vector))).first()[0] or 0
    schema = "query_id long, rank int, neighbour_id long, distance int"
    if width <= 0:
        return spark.createDataFrame([], schema)
    base = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.col(row_id).isNotNull()).select(
        F.col(row_id).cast("long").alias("id"), sign_code(F.col(vector), width).alias("code"))
    base = saved(base.groupBy("id").agg(F.min("code").alias("code")), "codes")
    # the k + 1 smallest ids of a code: rank within salted parts first, so a hot code is split
    part = Window.partitionBy("code", F.pmod("id", F.lit(64))).orderBy("id")
    few = base.withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= k + 1)
    codes = saved(few.groupBy("code").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids")), "distinct")
    cuts = segments(width, codes.count())
    m = len(cuts)
    # from here on a code is the array of its segments
    cut = F.array(*[_bits(F.col("code"), width, lo, size) for lo, size in cuts]).alias("code")
    index = saved(codes.select(cut, "ids").select("code", "ids", _blocks(F.col("code"), cuts)).select("seg", "block", "code", "ids"), "index")
    sizes = saved(index.groupBy("seg", "block").agg(F.count(F.lit(1)).alias("codes")), "sizes")
    asking = base.where(queries(F.col("id"))).select("id", cut)
    pending = saved(asking.select("code").distinct().withColumn("kth", F.lit(width)), "pending")
    nearest = Window.partitionBy("code").orderBy("distance", "id")
    found = None
    for radius in range(max(size for _, size in cuts) + 1):
        met = _round(index, sizes, pending, cuts, radius, k, cell, visits)
        every = met if found is None else found.unionByName(met)
        kept = saved(every.withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= k + 1).drop("_n"), "found")
        discard(met, pending, *([found] if found is not None else []))
        found = kept
        reach = found.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
        pending = saved(reach.where((F.col("n") <= k) | (F.col("far") >= m * (radius + 1)))
                        .select("code", F.when(F.col("n") > k, F.col("far")).otherwise(width).alias("kth")), "pending")
        if pending.isEmpty():
            break
    lists = found.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("distance", F.col("id").alias("neighbour_id")))).alias("near"))
    out = asking.join(lists, "code").select(
        F.col("id").alias("query_id"), F.slice(F.filter("near", lambda x: x["neighbour_id"] != F.col("id")), 1, k).alias("near"))
    return out.select("query_id", F.posexplode("near").alias("_p", "_x")).select(
        "query_id", (F.col("_p") + 1).cast("int").alias("rank"), F.col("_x.neighbour_id").alias("neighbour_id"),
        F.col("_x.distance").cast("int").alias("distance"))


def op4_query(rows: DataFrame) -> DataFrame:
    """All rows whose id is divisible by 100, against all rows."""
    return top_k(rows.select("vec_id", "embedding"), lambda i: i % 100 == 0)


ORACLE_SQL = """
WITH c AS (
  SELECT vec_id, list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), 'string_agg', '')::BIT AS code
  FROM embeddings
), p AS (
  SELECT q.vec_id AS query_id, r.vec_id AS neighbour_id, bit_count(xor(q.code, r.code))::INTEGER AS distance
  FROM c q JOIN c r ON q.vec_id % 100 = 0 AND r.vec_id <> q.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id)::INTEGER AS rank, neighbour_id, distance
FROM p QUALIFY rank <= 10
"""

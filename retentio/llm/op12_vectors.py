"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors of one label (and length) are compared by cosine; equal vectors are one class. Classes are
placed in the ``HOMES`` nearest of a label's clusters, so the clusters overlap; a cluster is cut by
hash into shards of about ``SHARD`` classes.

* Build: per shard, every node keeps its nearest neighbours, leaving out those that are nearer to a
  neighbour it already keeps (robust pruning). Neighbours within the threshold are all judged; of the farther ones at most
  ``DEGREE`` are kept. Adjacency lists of the shards are made symmetric and united.
* Search: per (shard, block of queries), a beam goes greedily from the shard's medoid towards each
  query; a query that is a node of the shard also starts from itself. From everything found in range the search expands
  along the edges until no further node in range turns up. Every pair that it reports is verified in double
  precision; nothing is capped. A query visits all shards of its own clusters, so a dense cluster of any size is searched
  whole, block by block, and a pair is counted in the first cluster that both have.
* Tasks return a count per query and, for the components, an edge per member to the smallest member it hangs
  together with in that task: never the pairs.

Within a shard the pruned graph keeps a path that stays in range between any two nodes in range, so links
are missed only between classes without a common cluster; ``recall`` measures that against brute force.

Bounds: centroids are fitted on ``SAMPLE`` classes per centroid, at most ``CENTROIDS`` in all (that is what is
broadcast); past ``CENTROIDS * SHARD`` vectors clusters have more shards instead.

Defined results: a vector that is null, empty, zero or holds null or non-finite components, or has no label, has no link;
repeated rows are vectors of their own; an id on several rows is one node of the components, and each row
has the row's own number of links; null ids have component null and are kept; an empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.llm.common import saved
from retentio.llm.op6_urls import components

THRESHOLD = 0.93
SHARD = 1024        # classes per shard
HOMES = 2           # clusters of a class
DEGREE = 24         # neighbours of a node beyond the threshold
BEAM = 8            # nodes a greedy search keeps
CENTROIDS = 8192    # centroids over all labels
SAMPLE = 16         # classes per centroid that centroids are fitted on
ROUNDS = 6          # of the fit


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; by their largest component first, so that nothing overflows."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def fit_centroids(vectors: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means; the first centre is the first row, each next one the row farthest from all so far."""
    v = unit(vectors)
    best, at = v @ v[0], [0]
    while len(at) < min(k, len(v)):
        at.append(int(best.argmin()))
        best = np.maximum(best, v @ v[at[-1]])
    centres = v[at]
    for _ in range(rounds):
        near = (v @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, v)
        moved = np.abs(sums).max(axis=1) > 0
        centres[moved] = unit(sums[moved])
    return centres


def pruned_graph(v: np.ndarray, threshold: float = THRESHOLD, degree: int = DEGREE) -> np.ndarray:
    """Boolean adjacency of unit vectors: for all nodes at once, take the nearest candidate left and drop the candidates that
    are nearer to it than to the node; until none is left in range and ``degree`` or none beyond it."""
    n = len(v)
    near = (v @ v.T).astype(np.float32)
    alive = ~np.eye(n, dtype=bool)
    adj = np.zeros((n, n), bool)
    nodes = np.arange(n)
    far = np.zeros(n, int)
    while len(nodes):
        score = np.where(alive[nodes], near[nodes], -np.inf)
        pick = score.argmax(axis=1)
        got = score[np.arange(len(nodes)), pick]
        far[nodes] += got < threshold
        more = (got > -np.inf) & ((got >= threshold) | (far[nodes] <= degree))
        nodes, pick = nodes[more], pick[more]
        adj[nodes, pick] = True
        alive[nodes] &= near[pick] <= near[nodes]
        alive[nodes, pick] = False
    return adj | adj.T


def range_search(nodes: np.ndarray, neighbours: list[np.ndarray], queries: np.ndarray, own: np.ndarray,
                 threshold: float = THRESHOLD, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs in range. Greedy search from the medoid with a beam, for all queries in step; then
    everything in range is expanded along the edges until nothing new is in range. ``own`` is the query's node, or -1."""
    n, q = len(nodes), len(queries)
    centre = nodes.sum(axis=0)
    medoid = int((nodes @ centre).argmax())
    width = max((len(x) for x in neighbours), default=0)
    table = np.full((n, max(width, 1)), -1, np.int64)
    for i, x in enumerate(neighbours):
        table[i, :len(x)] = x
    seen = np.zeros((q, n), bool)
    sims = np.full((q, n), -2.0, np.float32)      # of the nodes looked at
    expanded = np.zeros((q, n), bool)

    def look(rows: np.ndarray, cols: np.ndarray) -> None:
        fresh = ~seen[rows, cols]
        rows, cols = rows[fresh], cols[fresh]
        seen[rows, cols] = True
        for a in range(0, len(rows), 65_536):
            r, c = rows[a:a + 65_536], cols[a:a + 65_536]
            sims[r, c] = np.einsum("ij,ij->i", queries[r], nodes[c])

    def step(rows: np.ndarray, cols: np.ndarray) -> None:
        expanded[rows, cols] = True
        to = table[cols]
        ok = to >= 0
        pairs = np.unique(np.repeat(rows, ok.sum(axis=1)) * n + to[ok])
        look(pairs // n, pairs % n)

    rows = np.arange(q)
    look(rows, np.full(q, medoid))
    look(rows[own >= 0], own[own >= 0])
    live = rows
    while len(live):
        score = sims[live]
        k = min(beam, n)
        top = np.argpartition(score, n - k, axis=1)[:, n - k:]
        order = np.take_along_axis(score, top, 1)
        open_ = (order > -2) & ~np.take_along_axis(expanded[live], top, 1)
        best = np.where(open_, order, -3.0).argmax(axis=1)
        go = open_.any(axis=1)
        live = live[go]
        if len(live):
            step(live, top[go, best[go]])
    slack = threshold - 1e-4                       # float32 looks; the caller verifies
    while True:
        rows, cols = np.nonzero((sims >= slack) & ~expanded)
        if not len(rows):
            break
        for a in range(0, len(rows), 16_384):
            step(rows[a:a + 16_384], cols[a:a + 16_384])
    return np.nonzero(sims >= slack)



def _build(threshold: float):
    def run(key, table):
        ids = table.column("class_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], unit(matrix(table.column("vec")).astype(np.float64)[order])
        adj = pruned_graph(v, threshold)
        return pa.table({"class_id": ids, "near": pa.array([ids[np.flatnonzero(a)] for a in adj], pa.list_(pa.int64()))})
    return run


def _groups(q: np.ndarray, n: np.ndarray, total: int) -> np.ndarray:
    """Smallest index that each of ``total`` nodes hangs together with, over the pairs (q, n)."""
    at = np.arange(total)
    while True:
        low = np.minimum(at[q], at[n])
        new = at.copy()
        np.minimum.at(new, q, low)
        np.minimum.at(new, n, low)
        new = new[new]
        if (new == at).all():
            return at
        at = new


def _search(threshold: float):
    def run(left, right):
        none = pa.table({"class_id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return none
        left, right = left.sort_by("class_id"), right.sort_by("class_id")
        ids, asked = left.column("class_id").to_numpy(), right.column("class_id").to_numpy()
        v, w = (unit(matrix(t.column("vec")).astype(np.float64)) for t in (left, right))
        near = []
        for x in left.column("near").combine_chunks():
            to = np.asarray(x.values.to_numpy(), np.int64)
            at = np.searchsorted(ids, to)
            ok = at < len(ids)
            ok[ok] = ids[at[ok]] == to[ok]
            near.append(at[ok])
        own = np.searchsorted(ids, asked)
        own = np.where((own < len(ids)) & (ids[np.minimum(own, len(ids) - 1)] == asked), own, -1)
        q, n = range_search(v.astype(np.float32), near, w.astype(np.float32), own, threshold)
        keep = asked[q] != ids[n]
        q, n = q[keep], n[keep]
        exact = np.concatenate([np.einsum("ij,ij->i", w[q[a:a + 65_536]], v[n[a:a + 65_536]]) for a in range(0, max(len(q), 1), 65_536)])
        q, n = q[exact >= threshold], n[exact >= threshold]
        # a pair counts in the first cluster of the query that the node has too
        homes, theirs = matrix(right.column("homes")), matrix(left.column("homes"))
        cluster, counted = right.column("cluster")[0].as_py(), np.ones(len(q), bool)
        for j in range(homes.shape[1]):
            earlier = (homes[q] == cluster).argmax(axis=1) > j
            counted &= ~(earlier & (theirs[n] == homes[q, j][:, None]).any(axis=1))
        links = np.bincount(q[counted], weights=left.column("copies").to_numpy()[n[counted]], minlength=len(asked)).astype(np.int64)
        both = np.unique(np.concatenate([ids, asked]))
        root = both[_groups(np.searchsorted(both, asked[q]), np.searchsorted(both, ids[n]), len(both))]
        count = np.zeros(len(both), np.int64)
        count[np.searchsorted(both, asked)] = links
        use = (count > 0) | (root != both)
        return pa.table({"class_id": both[use], "links": count[use], "root": root[use]})
    return run


def _place(centres: dict[tuple[int, int], np.ndarray], homes: int):
    """Add the nearest clusters of each row; -1 fills up where a label has fewer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.stack([b.column("label").to_numpy(zero_copy_only=False), b.column("dim").to_numpy(zero_copy_only=False)], axis=1)
            out = np.full((len(keys), homes), -1, np.int64)
            out[:, 0] = 0
            for key in {tuple(k) for k in keys.tolist()} & set(centres):
                at = np.flatnonzero((keys == key).all(axis=1))
                c = centres[key]
                near = unit(matrix(b.column("vec").take(pa.array(at))).astype(np.float64)) @ c.T
                m = min(homes, len(c))
                out[at, :m] = np.argsort(-near, axis=1, kind="stable")[:, :m]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(out), pa.list_(pa.int64()))], names=[*b.schema.names, "homes"])
    return run


def vector_classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: row's id and class key; classes: class_id, label, dim, vec, copies). Vectors that cannot link have no key."""
    vec = F.col("embedding").cast("array<double>")
    fine = (F.col("label").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull())
            & F.forall(vec, lambda x: F.abs(x) < float("inf")) & F.exists(vec, lambda x: x != 0) & F.col("vec_id").isNotNull())
    # + 0.0 turns a negative zero into zero
    key = F.when(fine, F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.transform(vec, lambda x: (x + F.lit(0.0)).cast("string"))).cast("binary"), 256))
    rows = saved(vectors.select(F.col("vec_id"), F.col("label").cast("long").alias("label"), F.when(fine, vec).alias("vec"), key.alias("key")), "vectors")
    classes = (rows.where("key is not null").groupBy("key")
               .agg(F.min("vec_id").cast("long").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.any_value("label").alias("label"), F.any_value("vec").alias("vec"))
               .withColumn("dim", F.size("vec").cast("long")))
    return rows, saved(classes, "classes")


def _centres(classes: DataFrame, shard: int, most: int) -> dict[tuple[int, int], np.ndarray]:
    """Centroids of the labels with more than a shard of classes; a bounded sample is fitted label by label."""
    big = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard)
    total = big.agg(F.sum("n")).first()[0]
    if not total:
        return {}
    share = min(1.0 / shard, most / total)
    plan = big.select("label", "dim", F.ceil(F.col("n") * share).cast("int").alias("k"), "n")
    lot = F.pmod(F.xxhash64("class_id", F.lit(1)), F.lit(1 << 20)) < F.ceil(F.lit(float(1 << 20)) * SAMPLE * F.col("k") / F.col("n"))
    drawn = classes.join(plan, ["label", "dim"]).where(lot)

    def fit(key, table):
        table = table.sort_by("class_id")
        c = fit_centroids(matrix(table.column("vec")), table.column("k")[0].as_py())
        return pa.table({"label": [key[0].as_py()] * len(c), "dim": [key[1].as_py()] * len(c), "at": range(len(c)), "centre": pa.array(list(c), pa.list_(pa.float64()))})

    got: dict[tuple[int, int], list] = {}
    fitted = drawn.select("label", "dim", "class_id", "vec", "k").groupBy("label", "dim").applyInArrow(fit, "label long, dim long, at long, centre array<double>")
    for r in fitted.orderBy("label", "dim", "at").collect():   # at most CENTROIDS and one per large label
        got.setdefault((r["label"], r["dim"]), []).append(r["centre"])
    return {k: np.array(c) for k, c in got.items()}


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD, homes: int = HOMES, centroids: int = CENTROIDS) -> DataFrame:
    """(vec_id, n_links, component_id) of every row."""
    rows, classes = vector_classes(vectors)
    placed = classes.drop("key").mapInArrow(_place(_centres(classes, shard, centroids), homes),
                                            "class_id long, copies long, label long, vec array<double>, dim long, homes array<long>")
    spread = placed.withColumn("cluster", F.explode("homes")).where("cluster >= 0")
    spread = saved(spread, "placed")
    key = ["label", "dim", "cluster"]
    sizes = spread.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    spread = saved(spread.join(sizes, key).withColumn("shard", F.pmod(F.xxhash64("class_id"), F.col("shards")).cast("int")), "spread")

    lists = spread.groupBy(*key, "shard").applyInArrow(_build(threshold), "class_id long, near array<long>")
    graph = lists.groupBy("class_id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # HOMES lists at most
    nodes = saved(spread.join(graph, "class_id"), "graph")

    # every shard of a cluster meets every block of its queries
    task = [*key, "shard", "part"]
    numbers = F.sequence(F.lit(0), F.col("shards") - 1)
    left = nodes.withColumn("part", F.explode(numbers)).select(*task, "class_id", "vec", "near", "homes", "copies")
    right = spread.withColumnRenamed("shard", "part").withColumn("shard", F.explode(numbers)).select(*task, "class_id", "vec", "homes")
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)
    found = left.groupBy(*task).cogroup(right.groupBy(*task)).applyInArrow(_search(threshold), "class_id long, links long, root long")
    found = saved(found, "found")
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    edges = saved(found.where("class_id <> root").select(F.col("class_id").alias("a"), F.col("root").alias("b")).distinct(), "links")
    roots = classes.select("key", "class_id", "copies").join(links, "class_id", "left")
    if edges.isEmpty():
        roots = roots.withColumn("component", F.col("class_id"))
    else:
        at = components(edges).select(F.col("node").alias("class_id"), "component")
        roots = roots.join(at, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    of = roots.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    return rows.select("vec_id", "key").join(of, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", F.col("vec_id").cast("long")).alias("component_id"))


def recall(vectors: DataFrame, found: DataFrame, every: int = 100, most: int = 1000, threshold: float = THRESHOLD) -> DataFrame:
    """Audit: links of the sampled vectors (ids divisible by ``every``, at most ``most``) by the search, by brute force, and their
    share. The sample is broadcast; all vectors of the table are compared with it in double precision."""
    rows, _ = vector_classes(vectors)
    asked = rows.where("key is not null").where(F.col("vec_id") % every == 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).collect()
    by = {}
    for r in asked:
        by.setdefault((r["label"], len(r["vec"])), []).append((r["vec_id"], r["vec"]))
    by = {k: (np.array([x[0] for x in v]), unit(np.array([x[1] for x in v]))) for k, v in by.items()}

    def count(batches):
        for b in batches:
            got = []
            for label, vec in zip(b.column("label").to_pylist(), b.column("vec")):
                vec = vec.values.to_numpy()
                if (label, len(vec)) in by:
                    ids, m = by[(label, len(vec))]
                    got.append(ids[m @ unit(vec[None, :])[0] >= threshold])
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(np.concatenate(got) if got else [], pa.int64())})

    exact = rows.where("key is not null").mapInArrow(count, "vec_id long").groupBy("vec_id").agg((F.count(F.lit(1)) - 1).alias("exact"))
    return exact.join(found, "vec_id").agg(F.sum("n_links").alias("found"), F.sum("exact").alias("exact")).withColumn(
        "recall", F.when(F.col("exact") == 0, 1.0).otherwise(F.col("found") / F.col("exact")))


def op12_query(vectors: DataFrame) -> DataFrame:
    return near_vectors(vectors).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


ORACLE_SQL = f"""WITH RECURSIVE v AS (
SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, c.c AS component_id, e.vec_id = c.c AS kept
FROM embeddings e JOIN comp c ON c.a = e.vec_id LEFT JOIN deg d ON d.a = e.vec_id"""

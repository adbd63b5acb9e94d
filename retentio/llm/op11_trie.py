"""Prefix trie of conversations from sorted longest-common-prefix lengths.

Every conversation is a sequence of turns, a turn a 128-bit digest of (role, text); texts do not
leave the task that reads them. The sequences are sorted over range partitions (blocks) by
(sequence, conv_id), and each row gets the number of turns it shares with the row before. The
members of a prefix of length d are then the rows around any one of them until that number falls below
d. Each candidate prefix finds the ends of that interval by itself, by binary search over a sparse
table of range minima; there is no stack and no order among candidates. A node is kept by its
first row, i.e. for the lengths above what the row shares with its predecessor. Everything below a node
is a range of rows, so its sums are differences of running sums and its smallest member a second range minimum.

Intervals that leave a block are cut into pieces, at most one per block, side and depth. A
sparse table over the minima of the blocks (one number each) names the block that owns a piece, and the
pieces of a node are added up by key. So no task holds more than a block, and the driver only one
row per block.

Defined results: rows with null conv_id belong to no conversation and are left out; null role
and text are empty; null turns come first and rows of equal turn are ordered by role, then by digest of
(role, text); repeated rows are turns of their own; an empty table gives no node. Other columns are not read. A
conversation (its digests and lengths, not its texts) is held as one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentio.llm.common import saved, shuffle_parts

HEADS = 6       # a rebuilt conversation starts with fewer turns of its base than this
FAMILY = 100    # conversations of one base
DIGEST = 32     # hex digits of a turn in the sort key
CHUNK = 256     # ids per string where the ids of a node come from several blocks
NO_ENDS = hashlib.sha256(b"").hexdigest()


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns: array of struct(id, chars)) in the order of the turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, DIGEST)
    rows = turns.where("conv_id is not null").select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"),
        F.struct("turn", role.alias("role"), digest.alias("id"), F.char_length(text).cast("long").alias("chars")).alias("t"))
    # dealt by base, so that rebuilding needs no further shuffle
    whole = rows.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return whole.select("base", "conv_id", F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["chars"].alias("chars"))).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the first h turns of the base conversation, then the own turns after the first h."""
    convs = conversations_of(turns).withColumn("_h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int"))
    of_base = F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, HEADS - 1))
    head = F.coalesce(F.max(of_base).over(Window.partitionBy("base")), F.slice("turns", 1, 0))
    convs = convs.withColumn("_head", head)
    own = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    return convs.select("conv_id", F.concat(F.slice("_head", 1, F.col("_h")), own).alias("turns"))


def common_turns(a: str, b: str) -> int:
    """Number of leading digests that two keys share; compared in doubling, then halving spans."""
    most = min(len(a), len(b)) // DIGEST
    low, step = 0, 1
    while low < most:
        end = min(low + step, most)
        if a[low * DIGEST:end * DIGEST] == b[low * DIGEST:end * DIGEST]:
            low, step = end, step * 2
        elif step == 1:
            break
        else:
            step = max(1, (end - low) // 2)
    return low


def _sorted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted block: position, turns shared with the row before (null for the first), and the
    keys of the first row and, on a row of its own, of the last."""
    block, pos, last = TaskContext.get().partitionId(), 0, None
    whole = lambda n, **c: pa.RecordBatch.from_pydict(
        {"block": pa.array([block] * n, pa.int32()), **{k: pa.array(v, t) for k, (v, t) in c.items()}})
    for batch in batches:
        keys = batch.column("key").to_pylist()
        shared = [common_turns(a, b) if a is not None else None for a, b in zip([last, *keys], keys)]
        n = len(keys)
        if n:
            edge = [keys[0] if pos == 0 else None] + [None] * (n - 1)
            yield whole(n, pos=(range(pos, pos + n), pa.int64()), conv_id=(batch.column("conv_id"), pa.int64()), lcp=(shared, pa.int64()),
                        chars=(batch.column("chars"), pa.list_(pa.int64())), edge=(edge, pa.string()))
            pos, last = pos + n, keys[-1]
    if pos:
        yield whole(1, pos=([-1], pa.int64()), conv_id=([None], pa.int64()), lcp=([None], pa.int64()), chars=([None], pa.list_(pa.int64())), edge=([last], pa.string()))


def _edge_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        shared = [-1 if p is None else common_turns(p, f) for p, f in zip(b.column("before").to_pylist(), b.column("first").to_pylist())]
        yield pa.RecordBatch.from_pydict({"block": b.column("block"), "lcp": pa.array(shared, pa.int64())})


class Minima:
    """Sparse table: minima of all spans of 2**k entries. Depths are searched from any position."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= self.n:
            half = 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-half], self.levels[-1][half:]))

    def right(self, start: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """First position >= start with a value below depth, else n."""
        at = start.copy()
        for k in reversed(range(len(self.levels))):
            fits = at + (1 << k) <= self.n
            jump = fits & (self.levels[k][np.where(fits, at, 0)] >= depth)
            at += jump.astype(np.int64) << k
        return at

    def left(self, end: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Last position < end with a value below depth, else -1."""
        at = end.copy()
        for k in reversed(range(len(self.levels))):
            fits = at - (1 << k) >= 0
            jump = fits & (self.levels[k][np.where(fits, at - (1 << k), 0)] >= depth)
            at -= jump.astype(np.int64) << k
        return at - 1

    def least(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Minimum of [start, end), which is not empty."""
        k = np.frexp((end - start).astype(np.float64))[1] - 1
        out = np.empty(len(start), np.int64)
        for j in np.unique(k):
            m = k == j
            out[m] = np.minimum(self.levels[j][start[m]], self.levels[j][end[m] - (1 << j)])
        return out


_OUT = pa.schema([("kind", pa.string()), ("block", pa.int32()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("n", pa.int64()),
                  ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("base", pa.int64()),
                  ("parent", pa.int64()), ("side", pa.string()), ("seq", pa.int64()), ("ends", pa.string())])
_OUT_SQL = ("kind string, block int, depth long, conv_id long, n long, children long, leaves long, saved long, "
            "base long, parent long, side string, seq long, ends string")


def _out(kind: str, block: int, n: int, /, **cols) -> pa.Table:
    have = {"kind": [kind] * n, "block": [block] * n, **cols}
    return pa.Table.from_arrays([pa.array(have[f.name], f.type) if f.name in have else pa.nulls(n, f.type) for f in _OUT], schema=_OUT)


def _block_nodes(edges: dict[int, int]):
    """Of one block: its closed nodes ('node'), the pieces of nodes that reach into the next block ('R')
    or come from an earlier one ('L'), id strings of such nodes ('ends'), and its minimum ('block')."""
    after = dict(zip(sorted(edges), [*[edges[b] for b in sorted(edges)[1:]], -1]))

    def run(key, table):
        block = key[0].as_py()
        t = table.sort_by("pos")
        conv = t.column("conv_id").to_numpy()
        lcp = t.column("lcp").fill_null(edges[block]).to_numpy().astype(np.int64)
        lens = pc.list_value_length(t.column("chars")).to_numpy().astype(np.int64)
        chars = np.concatenate([[0], np.cumsum(t.column("chars").combine_chunks().flatten().to_numpy())]).astype(np.int64)
        first = np.cumsum(lens) - lens
        upto = lambda i, k: chars[first[i] + np.maximum(k, 0)] - chars[first[i]]  # noqa: E731  code points of k turns
        rows, n, nxt = np.arange(len(conv)), len(conv), after[block]

        shared = np.concatenate([[0], np.cumsum(upto(rows, lcp))])
        ends_leaf = np.append(lcp[1:], nxt) < lens            # the last row of a sequence that nothing goes on from
        leaves = np.concatenate([[0], np.cumsum(ends_leaf)])
        depths, ids = Minima(lcp), Minima(conv)

        # candidates: the lengths of each row above what it shares with the row before
        count = np.maximum(lens - lcp, 0)
        at0 = np.cumsum(count) - count
        i = np.repeat(rows, count)
        d = lcp[i] + 1 + np.arange(len(i)) - at0[i]
        right = depths.right(i + 1, d)
        is_open = (right == n) & (d <= nxt)

        # parents: the length before, of the same row, or of the interval that a left search finds
        same = d > lcp[i] + 1
        heads = np.flatnonzero((count > 0) & (lcp >= 0))
        owner = depths.left(heads, lcp[heads])
        inside = owner >= 0
        parent = np.full(len(i), -1)
        parent[same] = np.flatnonzero(same) - 1
        parent[at0[heads[inside]]] = at0[owner[inside]] + lcp[heads[inside]] - lcp[owner[inside]] - 1
        from_left = np.zeros(len(i), bool)
        from_left[at0[heads[~inside]]] = True
        children = (d < lens[i]).astype(np.int64)
        np.add.at(children, parent[at0[heads[inside]]], 1)
        side = np.where(from_left, "L", np.where((parent >= 0) & is_open[np.maximum(parent, 0)], "R", ""))
        least = ids.least(i, right)
        above = np.where((side == "") & (parent >= 0), least[np.maximum(parent, 0)], -1)

        # conversations that end at a node: the rows equal to its first one
        new = np.flatnonzero(lcp < lens)
        stop = np.append(new[1:], n) if len(new) else new
        run_of = dict(zip(new.tolist(), stop.tolist()))
        text = lambda a, b: ",".join(map(str, conv[a:b].tolist()))
        own = np.flatnonzero(~is_open)
        sha = [hashlib.sha256(text(a, run_of[a]).encode()).hexdigest() if e == s else NO_ENDS
               for a, e, s in zip(i[own].tolist(), d[own].tolist(), lens[i[own]].tolist())]
        base = upto(i, d - 1)
        size = right - i
        null = lambda x, bad: pa.array(x, mask=bad)
        out = [_out("node", block, len(own), depth=d[own], conv_id=least[own], n=size[own], children=children[own], leaves=(leaves[right] - leaves[i])[own],
                    saved=(shared[right] - shared[i + 1] - (size - 1) * base)[own], parent=null(above[own], (side[own] != "") | (d[own] == 0)),
                    side=null(side[own].astype(object), side[own] == ""), ends=sha)]
        op = np.flatnonzero(is_open)
        out.append(_out("R", block, len(op), depth=d[op], conv_id=least[op], n=size[op], children=children[op], leaves=(leaves[right] - leaves[i])[op],
                        saved=(shared[right] - shared[i + 1])[op], base=base[op], side=null(side[op].astype(object), side[op] == "")))
        come = np.arange(lcp[0] + 1)
        if len(come):
            end = depths.right(np.zeros(len(come), np.int64), come)
            got = np.bincount(lcp[heads[~inside]], minlength=len(come))
            out.append(_out("L", block, len(come), depth=come, conv_id=ids.least(np.zeros(len(come), np.int64), end), n=end, children=got[:len(come)],
                            leaves=leaves[end], saved=shared[end]))
        spans = [("L", 0, int(new[0]) if len(new) else n)] if not len(new) or new[0] > 0 else []
        spans += [("R", a, run_of[a]) for a in i[op[d[op] == lens[i[op]]]].tolist()]
        for kind, a, b in spans:
            cut = range(a, b, CHUNK)
            out.append(_out("ends", block, len(cut), depth=[int(lens[a])] * len(cut), side=[kind] * len(cut), seq=list(cut),
                            ends=[text(x, min(x + CHUNK, b)) for x in cut]))
        out.append(_out("block", block, 1, depth=[int(lcp.min())]))
        return pa.concat_tables(out)
    return run


def _with_owner(blocks: np.ndarray, minima: np.ndarray):
    """Add the block that owns a piece: its own if the node begins there, else the last before whose minimum is below the depth."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Minima(minima)
        for b in batches:
            at = np.searchsorted(blocks, b.column("block").to_numpy()).astype(np.int64)
            left = np.array([s == "L" for s in b.column("at").to_pylist()], bool)
            own = np.where(left, blocks[np.maximum(table.left(at, b.column("depth").to_numpy()), 0)], b.column("block").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32())], names=[*b.schema.names, "owner"])
    return run


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node of id strings that come sorted: only the digest's state is held."""
    key, state = None, None
    done = lambda: pa.RecordBatch.from_pydict({"owner": pa.array([key[0]], pa.int32()), "depth": pa.array([key[1]], pa.int64()), "ends": [state.hexdigest()]})
    for b in batches:
        for k, text in zip(zip(b.column("owner").to_pylist(), b.column("depth").to_pylist()), b.column("ends").to_pylist()):
            if k != key:
                if key is not None:
                    yield done()
                key, state = k, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
    if key is not None:
        yield done()


def prefix_trie(convs: DataFrame) -> DataFrame:
    """Nodes of the trie of (conv_id, turns: array of struct(id, chars)), one row each."""
    spark = convs.sparkSession
    keyed = convs.select(F.col("conv_id").cast("long").alias("conv_id"), F.array_join("turns.id", "").alias("key"), F.col("turns.chars").alias("chars"))
    # equal sequences are told apart by conv_id, so that a hot one is spread over blocks
    dealt = keyed.repartitionByRange(shuffle_parts(spark), "key", "conv_id").sortWithinPartitions("key", "conv_id")
    rows = saved(dealt.mapInArrow(_sorted_rows, "block int, pos long, conv_id long, lcp long, chars array<long>, edge string"), "sorted")
    ends = rows.where("edge is not null").groupBy("block").agg(F.max(F.when(F.col("pos") == 0, F.col("edge"))).alias("first"),
                                                               F.max(F.when(F.col("pos") < 0, F.col("edge"))).alias("last"))
    ends = ends.select("block", "first", F.lag("last").over(Window.orderBy("block")).alias("before"))  # a row per block
    edges = {r["block"]: r["lcp"] for r in ends.mapInArrow(_edge_turns, "block int, lcp long").collect()}  # a number per block
    found = rows.where("pos >= 0").drop("edge").groupBy("block").applyInArrow(_block_nodes(edges), _OUT_SQL)
    found = saved(found, "nodes")
    lows = sorted((r["block"], r["depth"]) for r in found.where("kind = 'block'").select("block", "depth").collect())
    blocks, minima = (np.array([x[j] for x in lows], np.int64) for j in (0, 1))

    owned = lambda df: df.mapInArrow(_with_owner(blocks, minima), f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in df.schema)}, owner int")
    pieces = saved(owned(found.where("kind in ('L', 'R')").drop("ends", "seq", "parent").withColumnRenamed("kind", "at")), "pieces")
    nodes = pieces.groupBy("owner", "depth").agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.sum("children").alias("children"),
                                                 F.sum("leaves").alias("leaves"), F.sum("saved").alias("_s"), F.max("base").alias("_b"), F.max("side").alias("side"))
    strings = owned(found.where("kind = 'ends'").select("block", "depth", F.col("side").alias("at"), "seq", "ends"))
    hashes = (strings.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "block", "seq")
              .mapInArrow(_hash_ends, "owner int, depth long, ends string"))
    nodes = saved(nodes.join(hashes, ["owner", "depth"], "left").select(
        F.col("owner").alias("block"), "depth", "conv_id", "n", "children", "leaves",
        (F.col("_s") - (F.col("n") - 1) * F.col("_b")).alias("saved"), F.lit(None).cast("long").alias("parent"), "side",
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends")), "open")
    # which open node a block's piece of a depth belongs to: parents are looked up by block, never by the root alone
    up = (pieces.select(F.col("owner").alias("_o"), F.col("depth").alias("_d"), F.col("block").alias("_block"), F.col("at").alias("_at"))
          .join(nodes.select(F.col("block").alias("_o"), F.col("depth").alias("_d"), F.col("conv_id").alias("_up")), ["_o", "_d"])
          .select("_block", (F.col("_d") + 1).alias("_depth"), "_at", "_up"))
    every = found.where("kind = 'node'").select(nodes.columns).unionByName(nodes)
    every = every.join(up, (F.col("block") == F.col("_block")) & (F.col("depth") == F.col("_depth")) & (F.col("side") == F.col("_at")), "left")
    return every.select("conv_id", "depth", F.coalesce("parent", "_up").alias("parent_conv_id"), F.col("n").alias("n_convs"),
                        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def op11_query(conversations: DataFrame) -> DataFrame:
    return prefix_trie(rebuilt(conversations))


# crc32 bit by bit (reflected polynomial 0xEDB88320), as DuckDB has none
_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), "
        "lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda r, i: xor(r >> 1, (r & 1) * 3988292384))), 4294967295::BIGINT)")

ORACLE_SQL = f"""WITH own AS (
SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns,
       {_CRC} % {HEADS} AS h
FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
seqs AS (
SELECT o.conv_id, list_concat(coalesce(b.turns[1:o.h], []), o.turns[o.h + 1:]) AS seq
FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % {FAMILY}),
members AS (SELECT conv_id, seq, d AS depth, seq[1:d] AS prefix FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM seqs)),
nodes AS (
SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
       sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(seq) = depth), '')) AS ends_sha256,
       CASE WHEN depth > 0 THEN prefix[1:depth - 1] END AS up,
       CASE WHEN depth > 0 THEN length(any_value(prefix)[depth].t) ELSE 0 END AS chars
FROM members GROUP BY prefix, depth),
kids AS (SELECT up, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY up),
full_nodes AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.up = n.prefix),
below AS (
SELECT a.prefix, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((b.n_convs - 1) * b.chars) AS saved_tokens
FROM (SELECT prefix, prefix[1:d] AS top FROM (SELECT prefix, unnest(range(depth + 1)) AS d FROM nodes)) x
JOIN full_nodes b ON b.prefix = x.prefix JOIN nodes a ON a.prefix = x.top GROUP BY a.prefix)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children,
       CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN below b ON b.prefix = n.prefix LEFT JOIN nodes p ON n.up = p.prefix"""

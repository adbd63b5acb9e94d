"""The trie, near-duplicate vectors and the source audit against brute force, SQL and on edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from conftest import SF01
from retentio.llm import op11_trie, op12_vectors, op13_divergence

TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture()
def parts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", before)


def brute_trie(rows):
    """The contract read literally: every prefix of every rebuilt conversation is looked up in a dict."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    seqs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seqs[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[tuple(seqs[c][:d])].append(c)
    out = []
    for node, who in members.items():
        under = [x for x in members if x[:len(node)] == node]
        kids = [x for x in under if len(x) == len(node) + 1]
        leaves = [x for x in under if not any(len(y) == len(x) + 1 and y[:len(x)] == x for y in under)]
        cost = sum((len(members[x]) - 1) * len(x[-1][1]) for x in under if x)
        ends = ",".join(str(c) for c in who if len(seqs[c]) == len(node))
        out.append((who[0], len(node), members[node[:-1]][0] if node else None, len(who), len(kids), len(leaves), cost,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_rows(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


def made_turns(seed):
    rnd, rows = random.Random(seed), []
    for c in rnd.sample(range(-30, 420), 90):
        n = rnd.choice([1, 2, 3, 4, 8, 30 if rnd.random() < 0.1 else 2])
        for k in range(n):
            rows.append((c, k, rnd.choice(["user", "bot"]), rnd.choice(["", "a", "bé", "xyz"])))
    for c in range(1000, 1060):   # a large group of equal conversations
        rows += [(c, 0, "user", "same"), (c, 1, "bot", "saéme")]
    return rows


@pytest.mark.parametrize("blocks", [1, 3, 29])
def test_trie_equals_brute_force(spark, parts, blocks):
    parts(blocks)
    rows = made_turns(blocks)
    assert trie_rows(op11_trie.op11_query(spark.createDataFrame(rows, TURNS))) == brute_trie(rows)


def test_trie_edge_cases(spark):
    rows = [(7, None, None, None), (7, None, None, None), (7, 1, "user", "x" * 100_000), (8, 0, None, "t"), (8, 0, None, "t"),
            (None, 0, "user", "of nobody"), (100, 3, "a", "b"), (100, None, "a", None), (101, 0, "a", "")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], TURNS + ", depth int, block string")
    assert trie_rows(op11_trie.op11_query(df)) == brute_trie(rows)
    empty = op11_trie.op11_query(spark.createDataFrame([], TURNS))
    assert empty.collect() == [] and len(empty.columns) == 8


def test_trie_of_turnless_conversations(spark):
    # 205 rebuilds from a base that is absent and has as many own turns as it loses
    c = next(c for c in range(200, 300) if zlib.crc32(str(c).encode()) % 6 == 2)
    rows = [(c, 0, "u", "x"), (c, 1, "u", "y")]
    got = trie_rows(op11_trie.op11_query(spark.createDataFrame(rows, TURNS)))
    assert got == brute_trie(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_range_minima_against_loops():
    rnd = np.random.default_rng(5)
    v = rnd.integers(-1, 6, 77)
    table = op11_trie.Minima(v)
    for _ in range(300):
        i, d = int(rnd.integers(0, 77)), int(rnd.integers(0, 7))
        right = next((k for k in range(i, 77) if v[k] < d), 77)
        left = next((k for k in range(i - 1, -1, -1) if v[k] < d), -1)
        a = (np.array([i]), np.array([d]))
        assert table.right(*a)[0] == right and table.left(*a)[0] == left
        j = int(rnd.integers(i + 1, 78))
        assert table.least(np.array([i]), np.array([j]))[0] == v[i:j].min()


def brute_links(rows):
    fine = [(k, i, lab, np.array(e, float)) for k, (i, e, lab) in enumerate(rows)
            if i is not None and e and lab is not None and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    links, near = Counter(), defaultdict(set)
    for k, i, lab, e in fine:
        for m, j, lab2, f in fine:
            if k != m and lab == lab2 and len(e) == len(f):
                a, b = e / np.abs(e).max(), f / np.abs(f).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                    links[k] += 1
                    near[i].add(j)
    comp = {}
    for i in {r[0] for r in rows}:
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in near[todo.pop()] if j not in seen and not seen.add(j)]
        comp[i] = min(seen) if i is not None else None
    return sorted(((r[0], links[k], comp[r[0]], comp[r[0]] == r[0]) for k, r in enumerate(rows)), key=repr)


def made_vectors(seed, dim=12):
    rnd, rows = np.random.default_rng(seed), []
    for label in (1, 2, None):
        for _ in range(25):
            centre = rnd.normal(size=dim)
            for _ in range(int(rnd.integers(1, 9))):
                rows.append((centre + rnd.normal(size=dim) * rnd.choice([0.02, 0.15, 0.25])).tolist() + [label])
    ids = rnd.permutation(len(rows)).tolist()
    return [(i, r[:-1], r[-1]) for i, r in zip(ids, rows)]


VECTORS = "vec_id long, embedding array<double>, label int"


def vector_rows(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


@pytest.mark.parametrize("shard", [1024, 40])
def test_vectors_equal_brute_force(spark, shard):
    rows = made_vectors(shard)
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(50)]    # exact copies
    df = spark.createDataFrame(rows, VECTORS)
    found = op12_vectors.near_vectors(df, shard=shard)
    got = vector_rows(found.selectExpr("*", "vec_id = component_id AS kept"))
    want = brute_links(rows)
    assert sum(r[1] for r in got) >= (1 if shard == 1024 else 0.98) * sum(r[1] for r in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    if shard == 1024:
        assert got == want
    audit = op12_vectors.recall(df, found, every=3).first()
    assert 0.9 <= audit["recall"] <= 1 and audit["exact"] > 0


def test_dense_cluster_is_searched_whole(spark):
    """All 300 vectors are within the threshold of each other; shards of 32 must still count every link."""
    rnd = np.random.default_rng(3)
    centre = rnd.normal(size=16)
    rows = [(i, (centre + rnd.normal(size=16) * 0.05).tolist(), 4) for i in range(300)]
    got = vector_rows(op12_vectors.near_vectors(spark.createDataFrame(rows, VECTORS), shard=32, centroids=2).selectExpr("*", "vec_id = component_id AS kept"))
    assert got == brute_links(rows)


def test_vector_edge_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, inf], 1), (6, [nan, 1.0], 1), (7, [1.0, 0.0], None),
            (8, [1.0, 0.0], 1), (8, [1.0, 0.0], 1), (9, [2.0, -0.0], 1), (10, [1e300, 1e200], 1), (11, [1.0, 0.0, 0.0], 1), (12, [-1.0, 0.0], 1),
            (13, [1.0, 0.0], 2), (None, [1.0, 0.0], 1), (14, [1e-300, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], VECTORS + ", cluster string, key int")
    got = vector_rows(op12_vectors.op12_query(df))
    want = brute_links(rows)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert {r[0]: r[3] for r in got}[8] and {r[0]: r[3] for r in got}[9] is False
    empty = op12_vectors.op12_query(spark.createDataFrame([], VECTORS))
    assert empty.collect() == [] and empty.columns == ["vec_id", "n_links", "component_id", "kept"]


def test_pruned_graph_keeps_paths_in_range():
    rnd = np.random.default_rng(8)
    v = op12_vectors.unit(np.concatenate([rnd.normal(size=8) + rnd.normal(size=(40, 8)) * 0.3 for _ in range(6)]))
    adj, near = op12_vectors.pruned_graph(v), (v @ v.T) >= 0.93
    for q in range(len(v)):
        seen, todo = {q}, [q]
        while todo:
            todo += [j for j in np.flatnonzero(adj[todo.pop()] & near[q]).tolist() if j not in seen and not seen.add(j)]
        assert seen == set(np.flatnonzero(near[q]).tolist())


TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_audit(rows, top=200):
    words = [(lang or "", source or "", [w.translate(LOWER) for w in TERM.findall(text or "")]) for text, lang, source in rows]
    out = []
    for lang in {w[0] for w in words}:
        df = Counter(t for la, _, ws in words if la == lang for t in set(ws))
        kept = sorted(t for t in df if df[t] >= 3)
        count = defaultdict(Counter)
        whole = Counter()
        for la, s, ws in words:
            if la == lang:
                count[s].update(w for w in ws if df[w] >= 3)
                whole.update(w for w in ws if df[w] >= 3)
        price = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: price(c) for s, c in count.items()}, price(whole)
        gain = lambda a, b: (a - b) ** 2 // b
        for s in count:
            pair = sorted((-sum(gain(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in count if o != s)
            term = sorted((-gain(p[s][t], q[t]), t.encode(), t) for t in kept if count[s][t] > 0 and p[s][t] > q[t])[:top]
            for part, ranked in (("pair", pair), ("term", term)):
                out += [(lang, s, part, x, -v, k) for k, (v, _, x) in enumerate(ranked, 1)]
    return sorted(out)


def audit_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


DOCS = "text string, lang string, source string"


def made_docs(seed):
    rnd = random.Random(seed)
    vocabulary = ["Zoé", "naïve", "été", "日本", "a", "b", "Straße", "don't", "x1y", "ÀB", *(chr(97 + i) * 2 for i in range(26))]
    rows = []
    for _ in range(120):
        source = rnd.choice(["s1", "s1", "s1", "s2", "é", "z", None])
        rows.append((" ".join(rnd.choice(vocabulary[:rnd.randrange(2, 36)]) for _ in range(rnd.randrange(0, 40))), rnd.choice(["en", "de", None]), source))
    return [*rows, *rows[:5], (None, "en", "silent"), ("", "xx", "only"), ("1 2 3", "yy", "a"), ("one two", "yy", "b")]


@pytest.mark.parametrize("block", [65_536, 4])
def test_audit_equals_brute_force(spark, block):
    rows = made_docs(block)
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], DOCS + ", block int, term string")
    assert audit_rows(op13_divergence.divergence(df, block=block)) == brute_audit(rows)


def test_audit_edge_cases(spark):
    long = "w" * 3_000_000 + " " + "ab cd " * 400_000
    rows = [(long, "en", "a"), ("ab", "en", "b"), ("AB cd", "en", "c"), ("cd", "en", "a")]
    assert audit_rows(op13_divergence.divergence(spark.createDataFrame(rows, DOCS))) == brute_audit(rows)
    empty = op13_divergence.op13_query(spark.createDataFrame([], DOCS))
    assert empty.collect() == [] and empty.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_gallop_finds_all_common_ids():
    rnd = np.random.default_rng(2)
    for a, b in ((0, 10), (5, 5000), (300, 400), (1000, 1000), (64, 65)):
        x, y = (np.unique(rnd.integers(0, 6000, n)) for n in (a, b))
        i, j = op13_divergence.gallop(x, y)
        assert x[i].tolist() == y[j].tolist() == np.intersect1d(x, y).tolist()


def test_prices_are_exact_for_huge_counts():
    n = np.array([0, 1, 10**15, 4 * 10**15])
    total = 8 * 10**15 + 7
    assert op13_divergence._price(n, total).tolist() == [1 + 10**9 * (int(x) + 1) // total for x in n]


@pytest.mark.parametrize("table,query,sql", [
    ("conversations", op11_trie.op11_query, op11_trie.ORACLE_SQL),
    ("embeddings", op12_vectors.op12_query, op12_vectors.ORACLE_SQL),
    ("documents", op13_divergence.op13_query, op13_divergence.ORACLE_SQL)])
def test_whole_table_equals_sql(spark, table, query, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF01}/{table}.parquet')")
    rel = con.sql(sql)
    got = query(spark.read.parquet(f"{SF01}/{table}.parquet"))
    assert sorted(tuple(r) for r in got.select(*rel.columns).na.fill(-1).collect()) == sorted(
        tuple(-1 if x is None else x for x in r) for r in rel.fetchall())

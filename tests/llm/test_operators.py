"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from retentio.llm import (op1_licenses, op2_syncmers, op3_jaccard, op4_topk, op5_mixing, op6_urls, op7_language, op8_toxicity,
                          op9_packing, op10_warc)

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r for r in docs.collect()}


def test_licences_finds_exactly_the_licence_lines(docs, texts):
    said = {"Apache License, Version 2.0": "Apache", "MIT License": "MIT", "GNU General Public License": "GPL", "CC BY-NC 4.0": "CC-BY-NC"}
    want = {(i, p, fam) for i, r in texts.items() for p, line in enumerate(r.text.split("\n")) for name, fam in said.items()
            if name in line and "under" in line}
    found = op1_licenses.scan(docs, op1_licenses.train(docs)).collect()
    got = {(r.doc_id, r.paragraph, r.family) for r in found if r.confirmed}
    assert got == want


def test_syncmers_edit_rule_and_anchors(docs, texts):
    rows = {r.doc_id: r for r in op2_syncmers.op2_query(docs).collect()}
    order = sorted(texts, reverse=True)
    for i, d in enumerate(order):
        t, nxt = texts[d].text, texts[order[(i + 1) % len(order)]].text
        cut = len(t) // 3
        assert rows[d].edited_sha256 == hashlib.sha256((t[:len(t) - cut] + nxt[:cut]).encode()).hexdigest()
        assert rows[d].n_chars == len(t)
        assert 0 <= rows[d].near_next <= 1
    assert np.mean([r.near_edited for r in rows.values()]) > 0.55 > 0.05 > np.mean([r.near_next for r in rows.values()])
    by_text = defaultdict(set)
    for d, r in rows.items():
        by_text[texts[d].text].add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_syncmers_are_context_free(spark):
    core = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, core), (2, "some words stand before " + core + " and after")], "doc_id long, text string")
    a, b = [set(r.anchors) for r in op2_syncmers.fingerprints(df).orderBy("doc_id").collect()]
    assert a <= b


def brute_components(texts, n, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(lower))
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    seen = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for g in sets[i] for j in seen[g])
        for g in sets[i]:
            seen[g].append(i)
        for j, k in shared.items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in sets}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_join_equals_brute_force(docs, texts, n, percent):
    want, sizes = brute_components({i: r.text for i, r in texts.items()}, n, percent)
    got = op3_jaccard.jaccard_components(docs, n, percent).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes


def test_join_of_edited_copies_and_small_sets(spark):
    """Chains of edits around the threshold, from one word up: every band and form of segments."""
    rng = np.random.default_rng(5)
    rows = []
    for size in (1, 2, 3, 4, 5, 6, 8, 11, 15, 22, 31, 47, 70, 120, 300):
        base = [f"t{x}" for x in rng.integers(0, 5000, size)]
        for _ in range(12):
            w = list(base)
            for _ in range(int(rng.integers(0, max(2, size // 8)))):
                w[int(rng.integers(0, len(w)))] = f"e{rng.integers(0, 40)}"
            rows.append((len(rows) + 10, " ".join(w)))
            if rng.random() < 0.3:
                base = w
    want, _ = brute_components(dict(rows), 1, 85)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in op3_jaccard.jaccard_components(df, 1, 85).collect()}
    assert got == want


def test_top_k_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    with duckdb.connect() as con:
        con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
        want = set(con.sql(op4_topk.ORACLE_SQL).fetchall())
    assert {tuple(r) for r in op4_topk.op4_query(rows).select("query_id", "rank", "neighbour_id", "distance").collect()} == want


def test_mix_meets_targets(spark, docs, texts):
    rows = op5_mixing.op5_query(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    size = {i: len(WORD.findall(r.text)) for i, r in texts.items()}
    total = sum(size.values())
    by_source = defaultdict(int)
    for i, r in texts.items():
        by_source[r.source] += size[i]
    # the contract's own words: share out, hold at the cap, share the excess anew
    names = sorted(by_source)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * total, set(names)
    while open_:
        full = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / full >= 2 * by_source[s]}
        for s in over or open_:
            target[s] = 2.0 * by_source[s] if over else left * weight[s] / full
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    taken = Counter()
    for r in rows:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size
        assert r.target == pytest.approx(target[texts[r.doc_id].source]) and r.source_size == by_source[texts[r.doc_id].source]
        taken[texts[r.doc_id].source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)


def test_url_rules(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for r in pages.collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r.url)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in op6_urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want[r.page_id] = (host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in op6_urls.op6_query(spark, pages).collect()}
    assert got == want


def test_blocks_reach_aliases_but_not_allowed_ones(spark):
    canon = '<link rel="canonical" href="{}">'.format
    move = '<meta http-equiv="refresh" content="0; url={}">'.format
    rows = [(1, "http://a.net/x", canon("http://b.net/y")), (2, "https://b.net/y#top", move("http://m.example.org/es/1")),
            (3, "http://c.org/z", canon("http://a.net/x")), (4, "http://d.net/q", canon("/r")), (5, "http://d.net/r", ""),
            (6, "nothing", canon("http://a.net/x")), (7, None, None)]
    got = {r.page_id: (r.rule, r.verdict) for r in op6_urls.op6_query(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: (None, "block"), 2: (None, "block"), 3: ("org/", "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"),
                   7: (None, "allow")}


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(300, 301)]
    got = {r.node: r.component for r in op6_urls.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {v for k, v in got.items() if k <= 60} == {0} and {v for k, v in got.items() if 100 <= k < 300} == {100} and got[301] == 300


def test_cross_parsing_equals_naive_longest_matches():
    rng = np.random.default_rng(1)
    words = ["".join(chr(97 + x) for x in rng.integers(0, 5, 4)) for _ in range(60)]
    train = {"aa": " ".join(words[:30]), "bb": " ".join(words[25:])}
    model = op7_language.CrossParser({k: op7_language.code_points(v).tolist() for k, v in train.items()})
    for text in ("abcde " * 30, " ".join(words[10:40]), "zzz", "a"):
        codes = op7_language.code_points(text)
        for j, lang in enumerate(model.langs):
            seen, count, at = "".join(map(chr, op7_language.code_points(train[lang]))), 0, 0
            s = "".join(map(chr, codes))
            while at < len(s):
                n = 0
                while at + n < len(s) and s[at:at + n + 1] in seen:
                    n += 1
                at, count = at + max(1, n), count + 1
            rate = count * math.log2(len(seen)) / len(codes)
            assert model.rates([codes])[0, j] == pytest.approx(rate, rel=2 / max(2, count))


def test_language_on_held_out_rows(docs, texts):
    got = op7_language.op7_query(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    rest = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == texts[r.doc_id].lang for r in rest]) > 0.95


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(2)
    vocab = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    made = [" ".join(rng.choice(vocab, rng.integers(3, 80), p=(p := 1 / np.arange(1, 301)) / p.sum())) for _ in range(400)]
    index = op8_toxicity.ExampleIndex(list(range(400)), made, [i % 2 for i in range(400)], {}, 400, 0.5, k=9)
    dense = np.zeros((400, len(index.terms)))
    for i, t in enumerate(made):
        term, w = index.vector(op8_toxicity.term_counts(t))
        dense[i, term] = w
    for t in made[:60]:
        term, w = index.vector(op8_toxicity.term_counts(t))
        _, cosine = index.nearest(term, w)
        assert np.allclose(cosine, np.sort(dense[:, term] @ w)[::-1][:9])


def test_toxicity_catches_abuse_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = op8_toxicity.op8_query(docs, labels)
    toxic = docs.join(labels, "doc_id").select("doc_id", "toxic", "text")
    rows = got.join(toxic, "doc_id").where("held_out").collect()
    abuse = re.compile("idiot|stupid|moron|scum|trash|loser|worthless|pathetic|clown|disgusting")
    bad = [r for r in rows if r.toxic == 1 and len(abuse.findall(r.text.lower())) >= 2]
    clean = [r for r in rows if r.toxic == 0]
    assert np.mean([r.predicted for r in bad]) > 0.6 and np.mean([r.predicted for r in clean]) < 0.06
    assert all(0 <= r.score <= 1 for r in rows)


def test_packing_ids_places_and_fill(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = op9_packing.op9_query(docs).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for i, t in texts.items():
        ids = np.array([*tok.encode(t.text, add_special_tokens=False).ids, 1], "<u4")
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            piece = ids[4096 * k:4096 * (k + 1)]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (k, 4096 * k, len(piece), zlib.crc32(piece.tobytes()))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by_seq) <= math.ceil(sum(r.length for r in rows) / 4096) + 2


@pytest.mark.parametrize("text", ["Ein Wort, zwei. Drei!! (vier) x.y,z 'tis don't we'll 3.14 ΑΣ ΣΑΣ İstanbul éa    b\x1cc\x85d", "<|endoftext|> a",
                                  "\r\n\ta\tb  c", "naïve ﬁn ½ 漢字 🙂 ok.", "A" * 3000, "á ́b ,, .. a., b.,"])
def test_word_ids_equal_the_tokenizer(text):
    from tokenizers import Tokenizer
    path = op9_packing.default_tokenizer()
    ids = np.frombuffer(op9_packing.WordIds(path).of(text), "<u4").tolist()
    assert ids == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_packing_merges_over_several_rounds(spark):
    rng = np.random.default_rng(3)
    sizes = [int(x) for x in rng.integers(1, 3000, 4000)]
    pieces = spark.createDataFrame([(i, i, 0, 0, n, 0) for i, n in enumerate(sizes)], op9_packing.PIECES)
    rows = op9_packing.packed(pieces, group_items=300).collect()
    fill = Counter()
    for r in rows:
        fill[r.bin] += r.length
    assert len(rows) == 4000 and max(fill.values()) <= 4096 and len(fill) <= 1.03 * sum(sizes) / 4096 + 1


def test_warc_round_trip(spark, tmp_dir):
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(40)
    first = op10_warc.responses(pages)
    records = first.unionByName(op10_warc.derive(first))
    op10_warc.write_warc(records, f"{tmp_dir}/w")
    back = {(r.headers, r.block) for r in op10_warc.read_warc(spark, f"{tmp_dir}/w").collect()}
    rows = records.collect()
    assert back == {(r.headers, r.block) for r in rows}
    ids = {r.record_id: r for r in rows}
    assert len(ids) == 3 * 40
    for r in rows:
        assert r.content_length == len(r.block.encode()) and r.block_digest == op10_warc.digest(r.block.encode())
        if r.record_type != "response":
            source = ids[r.refers_to]
            assert source.record_type == "response" and r.target_uri == source.target_uri
            assert f"WARC-Refers-To: {source.record_id}" in r.headers
        if r.record_type == "metadata":
            assert source.payload_digest in r.block
    html = {r.page_id: r.html for r in pages.collect()}
    assert all(r.payload_digest == op10_warc.digest(html[r.page_id].encode()) for r in rows if r.record_type == "response")


def test_plain_text():
    html = "<html><head><title>T</title><style>p{}</style></head><body><p>a &amp; b<br>c</p><!-- x --><script>1<2</script><div>d  e</div></body>"
    assert op10_warc.plain_text(html) == "a & b\nc\nd e"


def test_ascending_alias_chains_are_followed_to_their_end(spark):
    canon = '<link rel="canonical" href="{}">'.format
    url = "http://a.net/p/{:04d}".format
    rows = [(i, url(i), canon(url(i + 1) if i < 400 else "http://m.example.org/es/1")) for i in range(401)] + [(999, "http://b.net/", "")]
    got = {r.page_id: r for r in op6_urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i].verdict for i in range(401)} == {"block"} and got[999].verdict == "allow"
    assert {got[i].component for i in range(401)} == {"a.net/p/0000"}


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 900, (700, 2))] + [(2000 + i, 2000 + (i + 1) % 300) for i in range(300)]
    edges += [(3000 + i, 4000 + i) for i in range(80)] + [(3000 + i, 4001 + i) for i in range(79)] + [(5000, 4999 - i) for i in range(90)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.component for r in op6_urls.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_licences_in_hard_wrapped_notices(spark, docs):
    import textwrap
    said = [(f, t) for f, ts in op1_licenses.NOTICES.items() for t in ts if f != op1_licenses.UNKNOWN and len(t) > 60]
    said += [("Apache", "This software is distributed under the terms of the Apache License, Version 2.0."),
             ("CC-BY-NC", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.")]
    rows = [(i, "\n".join(["some words stand here", "", *textwrap.wrap(t, 34 if len(t) < 130 else 72, initial_indent="# ", subsequent_indent="# "), "", "and after"]))
            for i, (_, t) in enumerate(said)]
    rows += [(100, "License: MIT\nLicense: Apache-2.0"), (103, "License: MIT\n\nLicense: Apache-2.0"), (101, "Licensed under the Apache\r\nLicense, Version 2.0."),
             (102, "This work is licensed under the GNU\nGeneral\nPublic License, version 3.")]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    found = op1_licenses.scan(made, op1_licenses.train(docs))
    got = defaultdict(list)
    for r in op1_licenses.with_lines(found, made).collect():
        got[r.doc_id].append((r.paragraph, r.family, r.confirmed, len(r.line.split("\n"))))
    whole = 0
    for i, (fam, t) in enumerate(said):
        # once, at the notice's first line unless one line of it is confirmed alone
        n, sure = len(rows[i][1].split("\n")), [x for x in got[i] if x[2]]
        assert n > 5 and [x[1] for x in sure] == [fam] and {x[1] for x in got[i]} <= {fam, op1_licenses.UNKNOWN}, (fam, t, got[i])
        assert sure[0][3] == 1 or (sure == got[i] and (sure[0][0], sure[0][3]) == (2, n - 4))
        whole += sure[0][3] > 1
    assert whole >= len(said) // 2
    assert sorted(x[1:3] for x in got[100]) == sorted(x[1:3] for x in got[103])
    assert [x[1] for x in got[101] if x[2]] == ["Apache"] and [x[1] for x in got[102] if x[2]] == ["GPL"]


def test_syncmers_of_short_and_unspaced_texts(spark):
    rng = np.random.default_rng(4)
    han = lambda n: "".join(chr(0x4E00 + int(x)) for x in rng.integers(0, 3000, n))
    word = lambda: "".join(chr(97 + int(x)) for x in rng.integers(0, 26, 6))
    rows = [han(300), "the quick brown fox jumps over it", "".join(word() for _ in range(60)), "Sphinx of black quartz judge my vow", han(90),
            " ".join(word() for _ in range(23)), " ".join("abcdef"[:2] + str(i) for i in range(46)), "🙂🙃" + han(30)]
    got = op2_syncmers.op2_query(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    for r in got:
        assert len(set(r.fingerprint.split())) > 5 and r.near_edited > 0.3 > 0.1 > r.near_next, r
    pair = [("w" + " w".join(map(str, range(n)))) for n in (20, 26, 47, 50)]
    sets = [set(r.anchors) for r in op2_syncmers.fingerprints(spark.createDataFrame(list(enumerate(pair)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert all(len(a & b) > 5 for a, b in zip(sets, sets[1:], strict=False))


def test_toxicity_neighbours_equal_brute_force_over_every_word(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    index = op8_toxicity.learn(docs, labels, op8_toxicity.learnable)
    texts = {r.doc_id: r.text for r in docs.collect()}
    df = Counter(w for t in texts.values() for w in op8_toxicity.term_counts(t).keys() & index.terms.keys())
    assert index.terms.keys() == set().union(*(op8_toxicity.term_counts(texts[i]) for i in index.ids))

    def weights(t):
        w = {x: (1 + math.log(n)) * math.log1p(len(texts) / df[x]) for x, n in op8_toxicity.term_counts(t).items() if x in index.terms}
        size = math.sqrt(sum(v * v for v in w.values()))
        return {x: v / size for x, v in w.items()}

    examples = [weights(texts[i]) for i in index.ids]
    opened = []
    for t in [texts[i] for i in sorted(texts)[:120]]:
        q = weights(t)
        cosine = [sum(v * e[x] for x, v in q.items() if x in e) for e in examples]
        best, found = index.nearest(*index.vector(op8_toxicity.term_counts(t)))
        opened.append(index.opened / index.blocks)
        want = sorted((c for c in cosine if c > 0), reverse=True)[:index.k]
        assert np.allclose(found, want) and np.allclose([cosine[i] for i in best], want)
    assert np.mean(opened) < 0.8


def test_toxicity_label_goes_with_its_text_where_an_id_repeats(spark):
    docs = spark.createDataFrame([(1, "you idiot scum"), (1, "zzz zzz"), (2, "nice calm day")], "doc_id long, text string")
    index = op8_toxicity.learn(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    assert sorted(zip(index.ids, index.labels.tolist())) == [(1, 1.0), (1, 1.0), (2, 0.0)]
    assert {"idiot", "zzz", "calm"} <= index.terms.keys()


def test_jaccard_equals_its_sql(spark, docs):
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
        want = sorted(con.sql(op3_jaccard.ORACLE_SQL).fetchall())
    got = sorted(tuple(r) for r in op3_jaccard.op3_query(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == want and any(c != i for i, _, c in got)

"""URL filters with redirect equivalence (DataFrame functions only).

Pages and the URLs they redirect to or name as canonical are nodes; connected components over
these edges are classes of aliases. A class with a node that a rule blocks passes the block on
to all its members, except those that an allow rule fits themselves.

Nodes are URLs without fragment and scheme, host lower-cased: http and https forms are one
node. Components are found by rounds of hooking every node to the smallest node in its
neighbourhood and of pointer jumping, on written tables and without a limit of rounds; only
nodes with an edge take part.

Defined results: a null URL or one without ``://`` has empty host and path, no rule and no
alias, and is allowed; null or empty HTML has no edges; repeated rows keep a row each;
relative canonical links are resolved against the page's host; self links count for nothing;
an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm.common import ascii_lower, discard, saved

# The rules of the registered query (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
TO = r"(?is)\burl\s*=\s*['\"]?([^\"'\s>;]+)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (len, rule, verdict) of the longest fitting rule, else null. A rule fits its host
    and all subdomains if the path starts with the rule's path."""
    def one(r):
        h, p, v = r
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        return F.when(fits, F.struct(F.lit(len(h + p)).alias("len"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
    found = [one(r) for r in rules]
    return F.array_max(F.array(*found)) if found else F.lit(None).cast("struct<len:int,rule:string,verdict:string>")


def node_of(url: Column) -> Column:
    """The identity of a URL in the alias graph: host (lower case) and the rest without fragment."""
    rest = F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))))


def _target(base: Column, link: Column) -> Column:
    scheme = F.regexp_extract(base, r"^(?s)(.*?)://", 1)
    folder = F.regexp_extract(path_of(base), r"^(?s)(.*/)", 1)
    root = F.concat(scheme, F.lit("://"), host_of(base))
    return (F.when(link == "", F.lit(None)).when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), link)
            .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
            .when(F.startswith(link, F.lit("/")), F.concat(root, link))
            .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None))
            .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), link)))


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) URLs: canonical links and meta-refresh redirects of the pages."""
    tidy = lambda c: F.replace(c, F.lit("&amp;"), F.lit("&"))
    links = F.array(tidy(F.regexp_extract(F.regexp_extract(F.col(html), LINK, 0), HREF, 1)),
                    tidy(F.regexp_extract(F.regexp_extract(F.col(html), REFRESH, 0), TO, 1)))
    return (pages.where(F.col(html).rlike("(?i)canonical|http-equiv") & F.col(url).contains("://"))
            .select(F.col(url).alias("src"), F.explode(links).alias("_l"))
            .select("src", _target(F.col("src"), F.col("_l")).alias("dst")).where("dst is not null"))


def _rooted(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, component) and the written table that holds it, with every label replaced by its own label until all are roots: a tree of
    depth d takes log2(d) looks. Every label is a node of ``label`` and none is above its node."""
    tables, label = [table], table
    while True:
        up = label.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        step = saved(label.join(up, label["component"] == up["_n"]).select("node", F.col("component").alias("old"), F.col("_c").alias("component")), "labels")
        done = step.where("old <> component").isEmpty()
        discard(tables[0])
        tables, label = [step], step.select("node", "component")
        if done:
            return label, step


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of the undirected ``edges`` (a, b): the smallest node
    reachable. Each round hooks every node to its smallest neighbour (a partially aggregated
    minimum, so a hub node costs a row per task), looks up the labels' labels until all are
    roots, and goes on with the edges between different roots. A root that is alone after a round has a smaller
    neighbour in the next, so two rounds at least halve the roots whatever the order of the ids; the rounds
    end when no edge is left. Edges and labels are written tables, so rounds do not add lineage."""
    both = lambda e: e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    rounds: list[DataFrame] = []
    tables: list[DataFrame] = []
    while not rounds or not left.isEmpty():
        near = both(left).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        label, table = _rooted(saved(near.select("node", F.least("node", "m").alias("component")), "labels"))
        rounds.append(label)
        tables.append(table)
        at = [label.select(F.col("node").alias(k), F.col("component").alias(f"_{k}")) for k in ("a", "b")]
        moved = left.join(at[0], "a").join(at[1], "b").where("_a <> _b")
        before, left = left, saved(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "edges")
        discard(before)
    # follow the rounds: a root of one is a node of the next if it had an edge left
    label = rounds[0]
    for later in rounds[1:]:
        up = later.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        label = label.join(up, label["component"] == up["_n"], "left").select("node", F.coalesce("_c", "component").alias("component"))
    discard(left)
    if len(rounds) > 1:
        label = saved(label, "labels")
        discard(*tables)
    return label


def filter_urls(pages: DataFrame, edges: DataFrame | None = None, rules=RULES, page_id: str = "page_id",
                url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, host, path, rule, verdict, component) of every page. ``edges`` (src, dst URLs)
    adds a redirect log to the links found in the pages."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    rows = (rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
            .withColumn("_r", matched_rule(F.col("host"), F.col("path"), rules)).withColumn("_node", node_of(F.col("url"))))
    links = alias_edges(pages, url, html)
    if edges is not None:
        links = links.unionByName(edges.select("src", "dst"))
    links = links.where("src is not null and dst is not null")
    links = saved(links.select("src", "dst", node_of(F.col("src")).alias("a"), node_of(F.col("dst")).alias("b")).where("a <> b"), "links")
    if links.isEmpty():
        classes = rows.sparkSession.createDataFrame([], "_n string, component string, _bad boolean")
    else:
        comp = components(links)
        ends = links.select(F.col("a").alias("node"), F.col("src").alias("u")).unionAll(links.select("b", "dst"))
        judged = ends.withColumn("_v", matched_rule(host_of(F.col("u")), path_of(F.col("u")), rules)["verdict"])
        bad = (judged.join(comp, "node").groupBy("component")
               .agg(F.max(F.coalesce(F.col("_v") == "block", F.lit(False))).alias("_bad")))
        classes = comp.join(bad, "component").select(F.col("node").alias("_n"), "component", "_bad")
    rows = rows.join(classes, F.col("_node") == F.col("_n"), "left")
    verdict = F.when(F.col("_r").isNotNull(), F.col("_r.verdict")).when(F.col("_bad"), "block").otherwise("allow")
    return rows.select("page_id", "url", "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"), "component")


def op6_query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")

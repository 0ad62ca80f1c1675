"""URL filter: rules, and trust and distrust propagated over the host graph.

Only DataFrame operations.  Rules (host and path prefix; the longest that fits
wins) judge the pages they fit.  The other pages get the verdict of their
host: trust flows along the links from the hosts of allowed pages, distrust
against the links from the hosts of blocked pages (a personalised PageRank
each, over one table), and a host is blocked where distrust is more than
``threshold`` of both.  A host that neither reaches is allowed.

Nodes are the hosts and their ancestor domains of two labels or more, with
pages or without.  Edges join two different nodes: the links of the pages
(anchors with an absolute or protocol-relative target, counted per pair of
hosts), and a two-way edge of weight 1 between a node and its parent domain.

Both walks are iterated until a bound on what is left shows that each is
within ``tolerance`` of its seeds' mass (:func:`propagated`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import dropped, written
from .text import table

# The production rules, (verdict, rule).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

_ABC, _abc = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"(?i)<a\s(?:[^>]*?\s)?href\s*=\s*[\"']?([^\"'\s>]+)"


def _place(url: Column) -> Column:
    """What follows the first ``://``, up to ``?``, ``#`` or the end; empty without ``://``."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), r"(?s)^[^?#]*", 0)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.substring_index(_place(url), "/", 1), _ABC, _abc)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    at = F.instr(_place(url), "/")
    return F.when(at > 0, F.substr(_place(url), at)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits as struct<rule, verdict>, else null; rules are a short list (it becomes one expression)."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, slash, p = rule.partition("/")
        same = (host == h) | host.endswith(f".{h}")
        fits.append(F.when(same & path.startswith(slash + p), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits, F.lit(None).cast("struct<rule: string, verdict: string>"))


def ancestors(host: Column) -> Column:
    """The host and its ancestor domains of two labels or more, from the host up."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.array_join(F.slice(labels, i + 1, n), "."))


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts of pages (host, html), and each node with its parent domain.

    Hosts that occur as targets only are nodes too.
    """
    outer = F.filter(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)), lambda u: u.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:)?//"))
    target = F.translate(F.regexp_extract("link", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), _ABC, _abc)
    links = pages.where(F.col("host") != "").select(F.col("host").alias("src"), F.explode(outer).alias("link")).select("src", target.alias("dst"))
    links = written(links.where((F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight")), "urls-links")
    seen = hosts.select("host").unionByName(links.select(F.col("dst").alias("host"))).distinct().select(ancestors(F.col("host")).alias("line"))
    kin = seen.select(F.explode(F.arrays_zip(F.slice("line", F.lit(1), F.size("line") - 1).alias("low"), F.slice("line", F.lit(2), F.size("line")).alias("high"))).alias("e"))
    kin = kin.select("e.low", "e.high").where(F.col("low").isNotNull() & F.col("high").isNotNull()).distinct()
    two = kin.select(F.explode(F.array(F.struct(F.col("low").alias("src"), F.col("high").alias("dst")), F.struct(F.col("high").alias("src"), F.col("low").alias("dst")))).alias("e")).select("e.src", "e.dst")
    return links.unionByName(two.withColumn("weight", F.lit(1.0))).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagated(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, plain: int = 8, most: int = 60) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust, distrust) over edges (src, dst, weight).

    Both walks run in one table keyed by walk and host, distrust over the
    reversed edges.  Masses are in pages, so the two can be compared; what
    stops at a host without edges is left out.

    A round maps masses v to s + damping * P v, which shrinks differences by
    ``damping`` at least (in the sum of absolute values), so after a round that
    changed a walk by e its masses are off by e * damping / (1 - damping) at
    most.  Rounds go on until that is within ``tolerance`` of the seeds' mass.
    After ``plain`` rounds and two more, the tail is extrapolated as a geometric
    series of every second difference, which only chooses where the next
    rounds begin.  ``most`` blocks of rounds are far more than the plain
    series needs; beyond them it is an error.
    """
    walks = edges.select(F.lit(0).alias("walk"), "src", "dst", "weight").unionByName(edges.select(F.lit(1).alias("walk"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    out = walks.groupBy("walk", "src").agg(F.sum("weight").alias("total"))
    walks = written(walks.join(out, ["walk", "src"]).select("walk", "src", "dst", (F.col("weight") / F.col("total")).alias("share")), "urls-walks")
    # the edges are dealt and sorted by their source once, and no round shuffles them; lost blocks are read from the table again
    dealt = walks.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "walk", "src").sortWithinPartitions("walk", "src").persist(StorageLevel.DISK_ONLY)
    start = seeds.select(F.posexplode(F.array("trust", "distrust")).alias("walk", "mass"), "host").where(F.col("mass") > 0)
    start = written(start.select("walk", "host", (F.col("mass") * F.lit(1 - damping)).alias("mass")), "urls-seeds")

    def step(state: DataFrame) -> DataFrame:
        moved = state.withColumnRenamed("host", "src").join(dealt.hint("merge"), ["walk", "src"]).select("walk", F.col("dst").alias("host"), (F.col("mass") * F.col("share") * F.lit(damping)).alias("mass"))
        return moved.unionByName(start).groupBy("walk", "host").agg(F.sum("mass").alias("mass"))

    state, old = start, []
    for _ in range(most):
        for _ in range(plain):
            state = step(state)
        state = written(state, "urls-state")
        one = step(state)
        rows = None
        for i, v in enumerate((state, one, step(one))):
            v = v.select("walk", "host", *[(F.col("mass") if i == j else F.lit(0.0)).alias(f"m{j}") for j in range(3)])
            rows = v if rows is None else rows.unionByName(v)
        now = written(rows.groupBy("walk", "host").agg(*[F.sum(f"m{j}").alias(f"m{j}") for j in range(3)]), "urls-state")
        dropped(*old)
        old = [state, now]
        off = now.groupBy("walk").agg((F.sum(F.abs(F.col("m2") - F.col("m1"))) * (damping / (1 - damping))).alias("off"))
        left = off.join(start.groupBy("walk").agg((F.sum("mass") / (1 - damping)).alias("all")), "walk")
        if left.where(F.col("off") > F.col("all") * tolerance).isEmpty():
            break
        tail = (F.col("m2") - F.col("m0")) * (damping**2 / (1 - damping**2))
        state = now.select("walk", "host", (F.col("m2") + tail).alias("mass"))
    else:
        raise RuntimeError(f"trust has not settled after {most} blocks of rounds")
    walk = lambda k: F.sum(F.when(F.col("walk") == k, F.greatest("m2", F.lit(0.0))).otherwise(0.0))
    ranks = written(now.groupBy("host").agg(walk(0).alias("trust"), walk(1).alias("distrust")), "urls-masses")
    dealt.unpersist()
    dropped(*old, start, walks)
    return ranks


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, threshold: float = 0.6, **how) -> DataFrame:
    """``pages`` (url, html) with ``host``, ``path``, ``rule``, ``verdict``, ``trust`` and ``distrust``.

    A null url, or one without ``://``, has an empty host, which is allowed.
    A null html has no links; a very long one is read whole.  Every row comes
    back, repeated rows too; columns of the new names are replaced.
    """
    new = ("host", "path", "rule", "verdict", "trust", "distrust")
    kept = [c for c in pages.columns if c not in new]
    at = pages.select(*kept, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    at = at.withColumn("_uf_rule", rule_of(F.col("host"), F.col("path"), rules))
    seen = lambda v: F.sum((F.coalesce(F.col("_uf_rule.verdict"), F.lit("")) == v).cast("double"))
    hosts = written(at.where(F.col("host") != "").groupBy("host").agg(seen("allow").alias("trust"), seen("block").alias("distrust")), "urls-hosts")
    edges = written(host_edges(at, hosts), "urls-edges")
    ranks = propagated(hosts, edges, **how)
    dropped(hosts, edges)
    both = F.col("trust") + F.col("distrust")
    # rounded, so that sums in another order cannot turn a tie
    bad = F.when(both > 0, F.round(F.col("distrust") / both, 6) > threshold).otherwise(F.lit(False))
    ranks = written(ranks.select("host", "trust", "distrust", bad.alias("_uf_bad")), "urls-ranks")
    verdict = F.coalesce(F.col("_uf_rule.verdict"), F.when(F.coalesce(F.col("_uf_bad"), F.lit(False)), "block").otherwise("allow"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return at.join(ranks, "host", "left").select(*kept, "host", "path", F.col("_uf_rule.rule").alias("rule"), verdict.alias("verdict"), zero("trust"), zero("distrust"))


def kept_pages(pages: DataFrame, **how) -> DataFrame:
    """The pages that are allowed, as they were."""
    return judged(pages, **how).where(F.col("verdict") == "allow").select(*pages.columns)


def result(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


#: The same by plain power series: the masses that take i steps, for 220 steps (0.85**220 is 3e-16).
ORACLE = rf"""
WITH RECURSIVE cut AS (SELECT page_id, url, html, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '(?s)^[^?#]*') ELSE '' END AS place FROM pages),
placed AS (SELECT page_id, html, translate(string_split(place, '/')[1], '{_ABC}', '{_abc}') AS host, CASE WHEN contains(place, '/') THEN substr(place, instr(place, '/')) ELSE '' END AS path FROM cut),
rules(verdict, rule, h, p) AS (VALUES {", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)}),
ruled AS (
  SELECT placed.*, (SELECT max_by(struct_pack(rule := rule, verdict := verdict), length(rule)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS r FROM placed),
hosts AS (SELECT host, count(*) FILTER (r.verdict = 'allow') AS trust, count(*) FILTER (r.verdict = 'block') AS distrust FROM ruled WHERE host <> '' GROUP BY 1),
targets AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["'']?([^"''\s>]+)', 1)) AS link FROM ruled WHERE host <> ''),
links AS (SELECT src, translate(regexp_extract(link, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), '{_ABC}', '{_abc}') AS dst FROM targets),
outer_links AS (SELECT src, dst, count(*) AS weight FROM links WHERE dst <> '' AND src <> dst GROUP BY 1, 2),
names AS (SELECT DISTINCT string_split(host, '.') AS l FROM (SELECT host FROM hosts UNION SELECT dst FROM outer_links)),
kin AS (SELECT DISTINCT array_to_string(l[i:], '.') AS low, array_to_string(l[i + 1:], '.') AS high FROM (SELECT l, unnest(range(1, len(l) - 1)) AS i FROM names)),
edges AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM outer_links UNION ALL SELECT low, high, 1 FROM kin UNION ALL SELECT high, low, 1 FROM kin) GROUP BY 1, 2),
both_ways AS (SELECT 0 AS walk, src, dst, weight FROM edges UNION ALL SELECT 1, dst, src, weight FROM edges),
walks AS (SELECT walk, src, dst, weight / sum(weight) OVER (PARTITION BY walk, src) AS share FROM both_ways),
term(i, walk, host, mass) AS (
  SELECT 0, walk, host, mass * 0.15::DOUBLE FROM (SELECT 0 AS walk, host, trust AS mass FROM hosts UNION ALL SELECT 1, host, distrust FROM hosts) WHERE mass > 0
  UNION ALL SELECT min(i) + 1, walk, dst, sum(mass * share * 0.85::DOUBLE) FROM term JOIN walks USING (walk) WHERE host = src AND i < 220 GROUP BY walk, dst),
masses AS (SELECT host, coalesce(sum(mass) FILTER (walk = 0), 0) AS trust, coalesce(sum(mass) FILTER (walk = 1), 0) AS distrust FROM term GROUP BY 1)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, CASE WHEN m.trust + m.distrust > 0 AND round(m.distrust / (m.trust + m.distrust), 6) > 0.6 THEN 'block' ELSE 'allow' END) AS verdict FROM ruled LEFT JOIN masses m USING (host)
"""

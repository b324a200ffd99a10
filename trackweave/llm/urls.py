"""URL filters: fixed rules first, then a path-template tree with labelled purity.

Each host is the root of a tree of path segments. Segments that look like numbers,
hashes or dates become wildcards by their form; where a node has more than ``fanout``
different children, the rare ones become wildcards, too. The tree is as deep as the
longest path, one level a segment; where nodes follow each other as only children, their
levels are reckoned at once. A node counts the labels of its whole subtree; from the top down,
branches of one parent whose purities do not differ significantly are merged. A
template is rejected if the purity of its merged branch, smoothed towards that of the
branch above and so on up to its host's and the corpus's, is below ``least_purity``.

Null urls and urls without ``://`` have an empty host and path and are judged alike.
Rows of ``labels`` that repeat a page count each; pages without a label count only as
support. Repeated pages are judged alike. Without labels every template has the prior
purity. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackweave.llm.common import materialize
from trackweave.llm.graphs import salted_join

#: (verdict, host, path) of the fixed rules; the longest that fits wins.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (pattern, wildcard), the first that fits.
FORMS = [
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "{date}"),
    (r"^[0-9]+$", "{n}"),
    (r"^[0-9]+[.][A-Za-z]{1,5}$", "{n}.ext"),
    (r"^[0-9a-fA-F]{8,}$", "{hash}"),
    (r"^[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}$", "{uuid}"),
]
#: Levels of the tree in one plan.
LEVELS = 4
#: Levels that the SQL spells out; it is the oracle of paths of no more segments.
DEPTH = 8


@dataclass(frozen=True)
class TemplateTree:
    fanout: int = 32
    support: int = 20  # a child with fewer pages is rare
    prior: float = 0.8  # purity without any label
    strength: float = 10.0  # labels' worth of a prior
    least_purity: float = 0.5
    z: float = 1.96


def host_and_path(url: Column) -> tuple[Column, Column]:
    some = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(some, PARTS, 1), UPPER, LOWER), F.regexp_extract(some, PARTS, 2)


def rule(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for kind, at, start in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        name, verdict = F.when(fits, F.lit(at + start)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def pieces(rest: Column, all_: Column) -> tuple[Column, Column]:
    """The steps of ``rest``, cut where one of ``all_`` parts from it or ends, and how many segments each has."""
    same = lambda other: F.array_position(F.zip_with(rest, other, lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False)) - 1
    cuts = F.array_sort(F.array_distinct(F.filter(F.transform(all_, same), lambda n: n > 0)))
    ends = F.array_distinct(F.array_append(cuts, F.size(rest).cast("long")))
    begin = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(ends, i - 1))
    levels = lambda end, i: (end - begin(i)).cast("int")
    name = lambda end, i: F.concat(F.lit("/"), F.array_join(F.slice(rest, (begin(i) + 1).cast("int"), levels(end, i)), "/"))
    return F.transform(ends, name), F.transform(ends, levels)


def templates(paths: DataFrame, model: TemplateTree) -> DataFrame:
    """Add ``template``, its ``steps`` and their ``levels`` down the tree to paths(host, path, ...), whatever their depth.

    Every ``LEVELS`` levels the paths that end are set aside, and so are those below a
    node with at most ``fanout`` different rests: no node there is wide, so they keep
    their segments. Segments between two branchings are one step of several levels.
    """
    form = lambda s: F.coalesce(*[F.when(F.rlike(s, F.lit(p)), F.lit(w)) for p, w in FORMS], s)
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    names = [*paths.columns, "template", "steps", "levels"]
    out = paths.withColumns({"_s": F.transform(segments, form), "template": F.lit(""), "steps": F.array().cast("array<string>"), "levels": F.array().cast("array<int>")})
    ended = []
    while True:
        deepest = out.agg(F.max(F.size("_s"))).first()[0] or 0
        for _ in range(min(LEVELS, deepest)):
            # the distinct children of every node: a table of nodes, not of pages
            out = out.withColumn("_c", F.get("_s", F.lit(0)))
            nodes = out.where(F.col("_c").isNotNull()).groupBy("host", "template", "_c").agg(F.count(F.lit(1)).alias("n"))
            wide = nodes.groupBy("host", "template").agg(F.count(F.lit(1)).alias("children"))
            rare = salted_join(nodes, wide, ["host", "template"]).where((F.col("children") > model.fanout) & (F.col("n") < model.support))
            rare = rare.select("host", "template", "_c", F.lit(True).alias("_rare"))
            out = salted_join(out, rare, ["host", "template", "_c"], "left")
            step = F.when(F.col("_c").isNull(), F.lit("")).when(F.col("_rare"), F.lit("/*")).otherwise(F.concat(F.lit("/"), F.col("_c")))
            out = out.withColumn("_step", step)
            steps = F.when(F.col("_step") == "", F.col("steps")).otherwise(F.array_append("steps", F.col("_step")))
            levels = F.when(F.col("_step") == "", F.col("levels")).otherwise(F.array_append("levels", F.lit(1)))
            out = out.withColumns({"template": F.concat("template", "_step"), "steps": steps, "levels": levels, "_s": F.slice("_s", 2, F.greatest(F.size("_s"), F.lit(1)))}).drop("_rare", "_c", "_step")
        if deepest <= LEVELS:
            break
        out = materialize(out, "url-levels")
        ended.append(out.where(F.size("_s") == 0).select(*names))
        going = out.where(F.size("_s") > 0)
        rests = materialize(going.groupBy("host", "template", "_s").agg(F.count(F.lit(1)).alias("n")), "url-rests")
        few = rests.groupBy("host", "template").agg((F.count(F.lit(1)) <= model.fanout).alias("_few"))
        going = materialize(salted_join(going, few, ["host", "template"]), "url-levels")
        # at most ``fanout`` rests a node
        narrow = rests.join(few.where("_few"), ["host", "template"]).groupBy("host", "template").agg(F.collect_list("_s").alias("_all"))
        rest = F.concat(F.lit("/"), F.array_join("_s", "/"))
        slow = salted_join(going.where("_few"), narrow, ["host", "template"])
        more, levels = pieces(F.col("_s"), F.col("_all"))
        ended.append(slow.withColumns({"template": F.concat("template", rest), "steps": F.concat("steps", more), "levels": F.concat("levels", levels)}).select(*names))
        out = going.where(~F.col("_few")).drop("_few")
    out = out.select(*names)
    for more in ended:
        out = out.unionByName(more)
    return out


def branches(stats: DataFrame, corpus: float, model: TemplateTree) -> DataFrame:
    """(host, node, branch, pooled) of every node of the tree, from stats(host, template, steps, n, k[, levels]).

    A node counts the labels of its whole subtree. From the top down, siblings whose
    purities, smoothed by their parent's, do not differ significantly from one to the
    next are merged to one branch, whose pooled purity smooths that of their children.
    Siblings with equal counts are one row before they are sorted, so a task sorts the
    different counts under a parent, however many siblings there are.
    """
    m = model.strength
    upto = lambda i: F.array_join(F.slice("steps", F.lit(1), i), "")
    if "levels" not in stats.columns:
        stats = stats.withColumn("levels", F.transform("steps", lambda _: F.lit(1)))
    levels = lambda i: F.when(i > 0, F.get("levels", i - 1)).otherwise(0)
    above = F.transform(F.sequence(F.lit(0), F.size("steps")), lambda i: F.struct(i.alias("depth"), upto(i).alias("node"), upto(F.greatest(i - 1, F.lit(0))).alias("parent"), levels(i).alias("levels")))
    nodes = stats.select("host", "n", "k", F.inline(above)).groupBy("host", "node", "parent", "depth", "levels").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    nodes = materialize(nodes, "url-nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    level = nodes.where("depth = 0").select("host", "node", F.lit(0).alias("branch"), ((F.col("k") + m * F.lit(corpus)) / (F.col("n") + m)).alias("pooled"))
    out = level
    key = ["host", "parent"]
    for depth in range(1, deepest + 1):
        known = level.select("host", F.col("node").alias("parent"), F.col("pooled").alias("p"))
        now = nodes.where(F.col("depth") == depth).select("host", "node", "parent", "levels", "n", "k")
        now = salted_join(now, known, key).withColumn("purity", (F.col("k") + m * F.col("p")) / (F.col("n") + m))
        alike = now.groupBy(*key, "n", "k").agg(F.first("p").alias("p"), F.first("purity").alias("purity"), F.count(F.lit(1)).alias("c"))
        order = Window.partitionBy(*key).orderBy("purity", "n")
        var = F.col("purity") * (1 - F.col("purity")) / (F.col("n") + m)
        apart = F.col("purity") - F.lag("purity").over(order) > model.z * F.sqrt(var + F.lag(var).over(order))
        begins = alike.withColumn("begins", F.when(F.coalesce(apart, F.lit(False)), 1).otherwise(0))
        merged = begins.withColumn("branch", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int"))
        pooled = merged.groupBy(*key, "branch").agg(((F.sum(F.col("k") * F.col("c")) + m * F.first("p")) / (F.sum(F.col("n") * F.col("c")) + m)).alias("pooled"))
        found = salted_join(merged.select(*key, "n", "k", "branch"), pooled, [*key, "branch"])
        placed = salted_join(now.select(*key, "node", "levels", "n", "k"), found, [*key, "n", "k"])
        # further levels of a step are only children with the same counts, each smoothed by the one above
        own = F.col("k") / F.greatest("n", F.lit(1))
        down = F.when(F.col("n") == 0, F.col("pooled")).otherwise(own + (F.col("pooled") - own) * F.pow(m / (F.col("n") + m), F.col("levels") - 1))
        longer = F.col("levels") > 1
        level = materialize(placed.select("host", "node", F.when(longer, 0).otherwise(F.col("branch")).alias("branch"), F.when(longer, down).otherwise(F.col("pooled")).alias("pooled")), "url-branches")
        out = out.unionByName(level)
    return out


def judge_urls(pages: DataFrame, labels: DataFrame, model: TemplateTree | None = None) -> DataFrame:
    """Verdict on every row of pages(page_id, url), given labels(page_id, good boolean).

    Returns page_id, host, path, rule, verdict, template, branch and purity.
    """
    model = model or TemplateTree()
    host, path = host_and_path(F.col("url"))
    placed = templates(pages.select("page_id", host.alias("host"), path.alias("path")), model)
    placed = materialize(placed, "urls")
    marks = labels.groupBy("page_id").agg(F.count("good").alias("labelled"), F.count_if("good").alias("good"))
    marked = placed.join(marks, "page_id", "left")
    stats = marked.groupBy("host", "template").agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k"), F.first("steps").alias("steps"), F.first("levels").alias("levels"))
    stats = materialize(stats, "url-templates")
    every = stats.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    corpus = ((every.k or 0) + model.strength * model.prior) / ((every.n or 0) + model.strength)
    judged = branches(stats, corpus, model).select("host", F.col("node").alias("template"), "branch", F.round("pooled", 6).alias("purity"))
    whole = salted_join(placed.drop("steps", "levels"), judged, ["host", "template"])
    fits, fixed = rule(F.col("host"), F.col("path"))
    verdict = F.coalesce(fixed, F.when(F.col("purity") < model.least_purity, "block").otherwise("allow"))
    return whole.select("page_id", "host", "path", fits.alias("rule"), verdict.alias("verdict"), "template", "branch", "purity")


def page_labels(labels: DataFrame) -> DataFrame:
    """labels(doc_id, quality, toxic) read as labels of the pages with these ids."""
    return labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))


def oracle(model: TemplateTree | None = None) -> str:
    """DuckDB SQL for ``judge_urls(pages, page_labels(labels))``."""
    model = model or TemplateTree()
    m = model.strength
    form = " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{w}'" for p, w in FORMS)
    cases = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in cases]
    name = " ".join(f"WHEN {f} THEN '{h + p}'" for f, (_, h, p) in zip(fits, cases, strict=True))
    fixed = " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, cases, strict=True))
    parts = [f"""
WITH t0 AS MATERIALIZED (SELECT *, '' AS template, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE {form} ELSE s END) AS segs FROM (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{PARTS}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '{PARTS}', 2) AS path FROM pages))"""]
    for k in range(DEPTH):
        parts.append(f"""n{k} AS (SELECT host, template, segs[{k + 1}] AS c, count(*) AS n FROM t{k} WHERE segs[{k + 1}] IS NOT NULL GROUP BY ALL),
r{k} AS (SELECT host, template, c FROM n{k} JOIN (SELECT host, template, count(*) AS children FROM n{k} GROUP BY ALL) USING (host, template) WHERE children > {model.fanout} AND n < {model.support}),
t{k + 1} AS MATERIALIZED (SELECT page_id, t.host, path, segs, t.template || CASE WHEN segs[{k + 1}] IS NULL THEN '' WHEN r.c IS NOT NULL THEN '/*' ELSE '/' || segs[{k + 1}] END AS template
  FROM t{k} t LEFT JOIN r{k} r ON r.host = t.host AND r.template = t.template AND r.c = t.segs[{k + 1}])""")
    levels = ",\n".join(
        f"""c{d} AS (SELECT x.host, x.node, v.node AS parent, x.n, x.k, pooled AS p, (x.k + {m} * pooled) / (x.n + {m}) AS purity FROM x JOIN v{d - 1} v ON v.host = x.host AND v.node = regexp_replace(x.node, '/[^/]*$', '') WHERE d = {d}),
e{d} AS (SELECT host, parent, n, k, any_value(p) AS p, any_value(purity) AS purity, count(*) AS c FROM c{d} GROUP BY host, parent, n, k),
b{d} AS (SELECT *, purity - lag(purity) OVER w > {model.z} * sqrt(purity * (1 - purity) / (n + {m}) + lag(purity * (1 - purity) / (n + {m})) OVER w) AS apart FROM e{d} WINDOW w AS (PARTITION BY host, parent ORDER BY purity, n)),
h{d} AS (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY host, parent ORDER BY purity, n)::INT AS branch FROM b{d}),
q{d} AS (SELECT host, parent, branch, (sum(k * c) + {m} * any_value(p)) / (sum(n * c) + {m}) AS pooled FROM h{d} GROUP BY host, parent, branch),
v{d} AS (SELECT host, node, branch, pooled FROM c{d} JOIN h{d} USING (host, parent, n, k) JOIN q{d} USING (host, parent, branch))"""
        for d in range(1, DEPTH + 2)
    )
    return (
        ",\n".join(parts)
        + f""",
p AS MATERIALIZED (SELECT page_id, host, path, template || CASE WHEN len(segs) > {DEPTH} THEN '/**' ELSE '' END AS template FROM t{DEPTH}),
l AS (SELECT doc_id AS page_id, count((quality = 1 AND toxic = 0)) AS n, count(*) FILTER (quality = 1 AND toxic = 0) AS k FROM labels GROUP BY 1),
s AS MATERIALIZED (SELECT host, template, coalesce(sum(n), 0)::BIGINT AS n, coalesce(sum(k), 0)::BIGINT AS k FROM p LEFT JOIN l USING (page_id) GROUP BY ALL),
g AS (SELECT (coalesce(sum(k), 0) + {m * model.prior}) / (coalesce(sum(n), 0) + {m}) AS corpus FROM s),
x AS MATERIALIZED (SELECT host, node, d, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM (SELECT host, n, k, d, array_to_string(string_split(template, '/')[1:d + 1], '/') AS node FROM (SELECT *, unnest(range(len(string_split(template, '/')))) AS d FROM s)) GROUP BY ALL),
v0 AS (SELECT host, node, 0 AS branch, (k + {m} * corpus) / (n + {m}) AS pooled FROM x, g WHERE d = 0),
{levels},
j AS (SELECT host, node AS template, branch, round(pooled, 6) AS purity FROM ({" UNION ALL ".join(f"SELECT * FROM v{d}" for d in range(DEPTH + 2))}))
SELECT page_id, host, path, CASE {name} END AS rule, coalesce(CASE {fixed} END, CASE WHEN purity < {model.least_purity} THEN 'block' ELSE 'allow' END) AS verdict, template, branch, purity
FROM p JOIN j USING (host, template)"""
    )

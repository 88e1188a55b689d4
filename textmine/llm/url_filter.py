"""URL filters: explicit rules first, then a path-template tree for each host.

*Rules* name a host suffix and a path prefix and allow or block; the longest
fitting rule wins.  URLs that no rule fits are judged by their template:

1. The path's segments are generalised by form (numbers, hexadecimal ids, very
   long segments become wildcards) and URLs are counted by (host, form).
2. Level by level, to the end of the longest path, the rare literal children of
   a node (no more URLs than the branch above has pseudo-labels) are replaced by
   one wildcard ``*`` if they are many, or nearly all different.  Children with
   more URLs stay literal, however many they are.
3. At each level the children of a node are ordered by their smoothed share of
   good labels; labelled neighbours whose shares do not differ significantly
   (a two-proportion test) are merged into one branch.
4. A branch's purity is its share of good labels, smoothed towards the purity
   of the branch above, up to the host and the whole table; a template whose
   purity is below ``least_purity`` is blocked.

The tree is built from the counts by (host, form), far fewer rows than URLs.
The windows of step 3 are over the distinct shares of a node's labelled
children, so they do not grow with the children.  A path's end is a child like
any other, so a path of k segments passes k + 1 levels; a node with one row is
finished without a tree.  The SQL twin has three levels and wildcards by node:
it equals the query on the given tables, whose paths have two segments.

Defined cases: a null URL, or one without ``://``, has an empty host and path,
fits no rule and belongs to the template of the empty host; duplicates are
counted as often as they occur and judged alike; ties of share are ordered by
segment; unlabelled branches take the purity above; a null key is passed on;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmine.llm.common import read_table, staged


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The production rules.
RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)
DEPTH = 3  # levels of the SQL twin; the query goes down every path to its end
_LEVELS = [f"t{i}" for i in range(1, DEPTH + 1)]


@dataclass(frozen=True)
class TreeParams:
    max_children: int = 32      # more rare literal children than this are one wildcard
    min_children: int = 8       # from this many on, nearly unique rare children are one wildcard
    unique_share: float = 0.5   # distinct children per URL that counts as nearly unique
    weight: float = 4.0         # pseudo-labels of the branch above; children with more URLs are not rare
    z: float = 1.96             # merge neighbours whose shares differ by fewer standard errors
    least_purity: float = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased (A-Z) host and the path without query and fragment; both empty without ``://``."""
    known = F.coalesce(url.contains("://"), F.lit(False))
    rest = F.substring(url, F.length(F.substring_index(url, "://", 1)) + 4, F.length(url))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.when(known, host).otherwise(F.lit("")), F.when(known, path).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Name of the longest fitting rule, else null (ties: the alphabetically first)."""
    best = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        best = F.when(fits, F.lit(r.name)).otherwise(best)
    return best


_FORMS = ((r"^[0-9]+$", "{n}"), (r"^[0-9]+\.[a-z]+$", "{n}.x"), (r"^[0-9a-f-]{8,}$", "{h}"))


def _form(segment: Column) -> Column:
    out = F.when(F.length(segment) > 32, F.lit("{long}")).otherwise(segment)
    for pattern, name in reversed(_FORMS):
        out = F.when(segment.rlike(pattern), F.lit(name)).otherwise(out)
    return F.when(segment.isNotNull(), out)


def _with_forms(d: DataFrame) -> DataFrame:
    """Adds ``forms``: the form of every segment of ``path``."""
    bare = F.regexp_replace("path", "^/|/$", "")
    segments = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "/"))
    return d.withColumn("forms", F.transform(segments, _form))


def _wildcards(live: DataFrame, p: TreeParams) -> DataFrame:
    """Step 2 of one level: adds ``child``, the form ``s`` or the wildcard for rare children (null: the path ends)."""
    above = ["host", "node"]
    kids = live.filter(F.col("s").isNotNull() & ~F.col("s").startswith("{")).groupBy(*above, "s").agg(F.sum("n").alias("n"))
    rare = kids.filter(F.col("n") <= p.weight)
    many = rare.groupBy(*above).agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    many = many.filter((F.col("c") > p.max_children)
                       | ((F.col("c") >= p.min_children) & (F.col("c") / F.col("n") > p.unique_share)))
    wild = rare.select(*above, "s").join(many.select(*above), above, "left_semi").withColumn("wild", F.lit(True))
    live = live.join(wild, [*above, "s"], "left")
    return live.withColumn("child", F.when(F.col("wild"), F.lit("*")).otherwise(F.col("s"))).drop("wild")


def _branches(live: DataFrame, p: TreeParams) -> DataFrame:
    """Steps 3 and 4 of one level: (host, node, child, rows, branch_purity) of every child."""
    above, w = ["host", "node"], F.lit(p.weight)
    node = live.groupBy(*above, "child").agg(F.sum("good").alias("good"), F.sum("labelled").alias("lab"),
                                             F.first("purity").alias("above"), F.count("*").alias("rows"))
    node = node.withColumn("m", F.col("lab") + w).withColumn("q", (F.col("good") + w * F.col("above")) / F.col("m"))
    seen = node.filter(F.col("lab") > 0)
    # Children of one share are never apart: the windows are over distinct shares.
    by = F.struct(F.col("child").isNotNull(), F.col("child"))
    shares = seen.groupBy(*above, "q").agg(F.min_by("m", by).alias("m"), F.max_by("m", by).alias("last"), F.first("above").alias("above"),
                                           F.sum("good").alias("good"), F.sum("lab").alias("lab"))
    order = Window.partitionBy(*above).orderBy("q")
    shares = shares.withColumn("q0", F.lag("q").over(order)).withColumn("m0", F.lag("last").over(order))
    pooled = (F.col("q") * F.col("m") + F.col("q0") * F.col("m0")) / (F.col("m") + F.col("m0"))
    error = F.sqrt(pooled * (F.lit(1.0) - pooled) * (F.lit(1.0) / F.col("m") + F.lit(1.0) / F.col("m0")))
    apart = F.coalesce((F.col("q") - F.col("q0") > F.lit(p.z) * error).cast("int"), F.lit(0))
    shares = shares.withColumn("apart", apart).withColumn("branch", F.sum("apart").over(order))
    whole = Window.partitionBy(*above, "branch")
    purity = (F.sum("good").over(whole) + w * F.col("above")) / (F.sum("lab").over(whole) + w)
    shares = shares.select(*above, "q", purity.alias("branch_purity"))
    columns = [*above, "child", "rows", "branch_purity"]
    # Without labels: the purity above, no merging.
    return seen.join(shares, [*above, "q"]).select(columns).unionByName(
        node.filter(F.col("lab") == 0).withColumn("branch_purity", F.col("above")).select(columns))


def template_tree(counts: DataFrame, p: TreeParams = TreeParams()) -> DataFrame:
    """(host, forms, node, purity, blocked) from ``counts`` (host, forms, n, labelled, good)."""
    counts, w = staged(counts, "url-counts"), F.lit(p.weight)
    total = counts.agg(F.sum("good").alias("g"), F.sum("labelled").alias("l"))
    total = total.select(((F.coalesce("g", F.lit(0)) + F.lit(1.0)) / (F.coalesce("l", F.lit(0)) + F.lit(2.0))).alias("prior"))
    up = counts.groupBy("host").agg(F.sum("good").alias("good"), F.sum("labelled").alias("lab")).withColumn("prior", total.scalar())
    up = up.select("host", ((F.col("good") + w * F.col("prior")) / (F.col("lab") + w)).alias("purity"))
    live = counts.join(up, "host").withColumn("node", F.array().cast("array<string>"))
    out = None
    for level in itertools.count():
        live = _wildcards(live.withColumn("s", F.get("forms", F.lit(level))), p)
        live = staged(live, "url-tree")  # each level reads the last one several times
        live = live.join(staged(_branches(live, p), "url-branches").withColumnRenamed("child", "c").withColumnRenamed("host", "h")
                         .withColumnRenamed("node", "v"), F.col("host").eqNullSafe(F.col("h")) & F.col("node").eqNullSafe(F.col("v"))
                         & F.col("child").eqNullSafe(F.col("c")))
        ended = F.col("child").isNull()
        node = F.when(ended, F.col("node")).otherwise(F.concat("node", F.array("child")))
        # A node with one row has no branches below: its levels, and the end of the
        # path, are smoothed one after the other without a tree.
        rest = F.when(ended, 0).otherwise(F.size("forms") - F.lit(level))
        chain = F.aggregate(F.sequence(F.lit(0), rest), F.col("branch_purity"),
                            lambda x, k: F.when(k == 0, x).otherwise((F.col("good") + w * x) / (F.col("labelled") + w)))
        below = F.when(ended, F.array().cast("array<string>")).otherwise(F.slice("forms", F.lit(level + 2), F.greatest(rest - 1, F.lit(0))))
        done = ended | (F.col("rows") == 1)
        live = staged(live.select("host", "forms", "n", "labelled", "good", F.when(done, F.concat(node, below)).otherwise(node).alias("node"),
                                  F.when(done, chain).otherwise(F.col("branch_purity")).alias("purity"), done.alias("done")), "url-level")
        ready = live.filter("done").select("host", "forms", "node", "purity")
        out = ready if out is None else out.unionByName(ready)
        live = live.filter(~F.col("done")).drop("done")
        if live.isEmpty():
            return out.withColumn("blocked", F.col("purity") < p.least_purity)


def judge(urls: DataFrame, labels: DataFrame, key: str = "page_id", url: str = "url", rules=RULES,
          params: TreeParams = TreeParams()) -> DataFrame:
    """(key, host, path, rule, template, purity, verdict) for every row of ``urls``.

    ``labels`` is (label_id, good): ``good`` 0 or 1 for the URLs whose last
    numeric path segment is ``label_id``, at most one row an id.
    """
    host, path = host_and_path(F.col(url))
    d = urls.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    d = d.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    d = _with_forms(d)
    number = F.regexp_extract("path", r"(?:^|/)([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    known = d.select("host", "forms", F.when(number != "", number.cast("long")).alias("label_id"))
    known = known.join(labels.select("label_id", "good"), "label_id", "left")
    counts = known.groupBy("host", "forms").agg(
        F.count("*").alias("n"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    tree = template_tree(counts, params)
    tree = tree.select("host", "forms", "purity", "blocked", F.concat(F.lit("/"), F.concat_ws("/", "node")).alias("template"))
    d = d.join(tree, ["host", "forms"], "left")
    verdict = F.when(F.col("blocked"), "block").otherwise("allow")
    for r in rules:
        verdict = F.when(F.col("rule") == r.name, F.lit(r.verdict)).otherwise(verdict)
    return d.select(F.col("key").alias(key), "host", "path", "rule", "template", "purity", verdict.alias("verdict"))


def page_labels(labels: DataFrame) -> DataFrame:
    """(label_id, good) from the documents' quality labels: a page's URL ends in its document's id."""
    return labels.groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("good"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = page_labels(read_table(spark, sf_dir, "labels"))
    judged = judge(read_table(spark, sf_dir, "pages"), labels)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _sql(p: TreeParams = TreeParams()) -> str:
    def form(x):
        tests = " ".join(f"WHEN regexp_matches({x}, '{pat}') THEN '{name}'" for pat, name in _FORMS)
        return f"(CASE WHEN {x} IS NULL THEN NULL {tests} WHEN length({x}) > 32 THEN '{{long}}' ELSE {x} END)"

    forms = ", ".join(f"s{i + 1}" for i in range(DEPTH))
    rule = " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'"
                    for r in sorted(RULES, key=lambda r: (-len(r.name), r.name)))
    parts = [f"""a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM a),
c AS (SELECT *, regexp_replace(path, '^/|/$', '', 'g') AS bare FROM b),
e AS (SELECT *, CASE WHEN bare = '' THEN [] ELSE string_split(bare, '/') END AS seg,
        try_cast(nullif(regexp_extract(path, '(?:^|/)([0-9]{{1,18}})(?:\\.[a-z]+)?/?$', 1), '') AS BIGINT) AS label_id FROM c),
f AS MATERIALIZED (SELECT page_id, host, path, label_id, {", ".join(form(f"seg[{i + 1}]") + f" AS s{i + 1}" for i in range(DEPTH))} FROM e),
lab AS (SELECT doc_id, min(quality) AS good FROM labels GROUP BY doc_id),
tree0 AS (SELECT host, {forms}, count(*) AS n, count(good) AS labelled, coalesce(sum(good), 0) AS good
          FROM f LEFT JOIN lab ON f.label_id = lab.doc_id GROUP BY ALL)"""]
    for i in range(DEPTH):
        above = ["host", *_LEVELS[:i]]
        s = f"s{i + 1}"
        lit = f"(t.{s} IS NOT NULL AND NOT starts_with(t.{s}, '{{'))"
        on = " AND ".join(f"t.{c} IS NOT DISTINCT FROM m.{c}" for c in above)
        parts.append(f"""many{i} AS (SELECT {", ".join(above)} FROM (SELECT {", ".join("t." + c for c in above)}, t.{s}, sum(n) AS n FROM tree{i} t WHERE {lit} GROUP BY ALL)
  GROUP BY ALL HAVING count(*) > {p.max_children} OR (count(*) >= {p.min_children} AND count(*)::DOUBLE / sum(n) > {p.unique_share})),
tree{i + 1} AS (SELECT t.*, CASE WHEN m.host IS NOT NULL AND {lit} THEN '*' ELSE t.{s} END AS {_LEVELS[i]}
  FROM tree{i} t LEFT JOIN many{i} m ON {on})""")
    top = f"tree{DEPTH}"
    parts.append(f"""prior AS (SELECT (coalesce(sum(good), 0) + 1.0::DOUBLE) / (coalesce(sum(labelled), 0) + 2.0::DOUBLE) AS prior FROM tree0),
up0 AS (SELECT host, prior, (sum(good) + {p.weight}::DOUBLE * prior) / (sum(labelled) + {p.weight}::DOUBLE) AS purity
        FROM {top}, prior GROUP BY host, prior)""")
    ends = []
    for i in range(DEPTH):
        above, keys = ["host", *_LEVELS[:i]], ["host", *_LEVELS[:i + 1]]
        live = f"WHERE {_LEVELS[i - 1]} IS NOT NULL" if i else ""
        if i:
            ends.append(f"SELECT {', '.join(above)}, {', '.join('NULL::VARCHAR AS ' + c for c in _LEVELS[i:])}, purity FROM up{i} WHERE {_LEVELS[i - 1]} IS NULL")
        on = " AND ".join(f"g.{c} IS NOT DISTINCT FROM u.{c}" for c in above)
        w = f"{p.weight}::DOUBLE"
        part = ", ".join(above)
        parts.append(f"""g{i} AS (SELECT {", ".join(keys)}, sum(good) AS good, sum(labelled) AS lab FROM {top} GROUP BY ALL),
n{i} AS (SELECT g.*, u.prior, u.purity AS above, lab + {w} AS m, (good + {w} * u.purity) / (lab + {w}) AS q, lab > 0 AS seen
  FROM g{i} g JOIN (SELECT * FROM up{i} {live}) u ON {on}),
l{i} AS (SELECT *, lag(q) OVER o AS q0, lag(m) OVER o AS m0 FROM n{i} WINDOW o AS (PARTITION BY {part}, seen ORDER BY q, {_LEVELS[i]} NULLS FIRST)),
z{i} AS (SELECT *, (q * m + q0 * m0) / (m + m0) AS pooled FROM l{i}),
a{i} AS (SELECT *, coalesce((q - q0 > {p.z}::DOUBLE * sqrt(pooled * (1.0::DOUBLE - pooled) * (1.0::DOUBLE / m + 1.0::DOUBLE / m0)))::INT, 0) AS apart FROM z{i}),
c{i} AS (SELECT *, sum(apart) OVER (PARTITION BY {part}, seen ORDER BY q, {_LEVELS[i]} NULLS FIRST) AS branch FROM a{i}),
up{i + 1} AS (SELECT {", ".join(keys)}, prior, (sum(good) OVER v + {w} * above) / (sum(lab) OVER v + {w}) AS purity
  FROM c{i} WINDOW v AS (PARTITION BY {part}, seen, branch))""")
    ends.append(f"SELECT {', '.join(keys)}, purity FROM up{DEPTH}")
    on = " AND ".join(f"t.{c} IS NOT DISTINCT FROM o.{c}" for c in keys)
    back = " AND ".join(f"f.{c} IS NOT DISTINCT FROM v.{c}" for c in ["host", *[f"s{i + 1}" for i in range(DEPTH)]])
    verdicts = " ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in RULES)
    parts.append(f"""o AS ({" UNION ALL ".join(ends)}),
v AS (SELECT t.host, {", ".join(f"t.s{i + 1}" for i in range(DEPTH))}, o.purity FROM {top} t JOIN o ON {on}),
x AS (SELECT f.page_id, f.host, f.path, v.purity, (CASE {rule.replace("host", "f.host").replace("path", "f.path")} END) AS rule FROM f LEFT JOIN v ON {back})
SELECT page_id, host, path, rule, CASE {verdicts} WHEN purity < {p.least_purity}::DOUBLE THEN 'block' ELSE 'allow' END AS verdict FROM x""")
    return "WITH " + ",\n".join(parts)


SQL = _sql()

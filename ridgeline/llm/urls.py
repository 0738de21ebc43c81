"""URL filter: host rules first, then a path-template tree per host.

Each host has a tree of path segments, read to any depth (what lies below
LEVELS segments is one last segment). A segment with a digit is a wildcard, with an
ending such as .html kept apart. From the root down, the other segments of a node
become wildcards too where they vary: LEAST_PAGES pages at least, and nearly as many
values as pages. The steps from the root are a page's template.

Labels come from the rules: a page that a rule blocks is bad, one that a rule
allows is good. Templates that differ in one step only are siblings at that level.
At every level, from the root down, a template merges with its siblings unless both
have labels and their shares of bad ones differ significantly (two-proportion
z-test); so a branch without labels is judged by the branches that look like it, and
below the level at which it differs by its own. A template's purity, the share of
bad ones among labelled pages, is smoothed by each wider population in turn:
its host, its merged siblings level by level, itself; each counts its labels and
STRENGTH pages of the one before, and the host those of PRIOR. A template is rejected
when its purity reaches BAD_SHARE. So pages without a rule are blocked where the labelled
pages of similar templates on their host are bad, and allowed on hosts without labels.

DataFrame functions only. Pages are counted by (host, shape of the path) with partial
aggregation before anything is shuffled, so a host with a third of all pages is as small as
its shapes; the tree is built on that table, and the join back to the pages is a
plain equi-join that adaptive execution can split.

Defined results: null urls and those without :// have an empty host and path, no
rule and the method's verdict for the empty host; ties between rules of one
length go to the first in the list; repeated rows are judged alike, each counted;
very long urls are read whole; an empty table gives no rows; extra columns are
ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import input_columns, save

#: (host, path, verdict), in the order given by the contract.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Levels of a tree; the last one holds the whole rest of a path.
LEVELS = 8
#: A node's segments vary when their distinct values are at least this share of its pages.
VARIES = 0.3
LEAST_PAGES = 5
BAD_SHARE = 0.5
#: Pages that a wider population counts for, and the share of bad ones before anything is seen.
STRENGTH = 5.0
PRIOR = 0.1
Z_LIMIT = 1.64


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of its name and verdict, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, v in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(out)
    return out


def _wild(segment: Column) -> Column:
    """The wildcard of a segment: * with the ending of a file name, if any."""
    return F.concat(F.lit("*"), F.lower(F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)))


def shape_of(path: Column) -> Column:
    """The segments of a path, those with digits as wildcards, and the rest below the last level as one."""
    all_ = F.filter(F.split(path, "/"), lambda s: s != "")
    tail = F.array_join(F.slice(all_, LEVELS, F.greatest(F.size(all_) - LEVELS + 1, F.lit(1))), "/")
    segments = F.when(F.size(all_) > LEVELS, F.concat(F.slice(all_, 1, LEVELS - 1), F.array(tail))).otherwise(all_)
    return F.transform(segments, lambda s: F.when(s.rlike(r"[0-9]") | s.startswith("*"), _wild(s)).otherwise(s))


def templates(shapes: DataFrame) -> DataFrame:
    """Adds the steps of the template to (host, shape, pages, labelled, bad)."""
    deepest = shapes.agg(F.max(F.size("shape"))).first()[0] or 0  # LEVELS at most
    rows = shapes.withColumn("steps", F.array().cast("array<string>"))
    for level in range(deepest):
        rows = rows.withColumn("segment", F.get("shape", F.lit(level)))
        values = rows.where(F.col("segment").isNotNull() & ~F.col("segment").startswith("*")).groupBy("host", "steps", "segment").agg(F.sum("pages").alias("n"))
        varies = values.groupBy("host", "steps").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).where((F.col("n") >= LEAST_PAGES) & (F.col("kinds") >= VARIES * F.col("n")))
        rows = rows.join(varies.select("host", "steps", F.lit(True).alias("varies")), ["host", "steps"], "left")
        step = F.when(F.col("varies") & ~F.col("segment").startswith("*"), _wild(F.col("segment"))).otherwise(F.col("segment"))
        steps = F.when(F.col("segment").isNull(), F.col("steps")).otherwise(F.array_append("steps", step))
        rows = save(rows.select("host", "shape", "pages", "labelled", "bad", steps.alias("steps")), f"url-level{level}")
    return rows


def purities(rows: DataFrame) -> DataFrame:
    """(host, steps, purity) of the templates of (host, steps, labelled, bad)."""
    tree = save(rows.groupBy("host", "steps").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")), "url-templates")
    hosts = tree.groupBy("host").agg(F.sum("labelled").alias("h_labelled"), F.sum("bad").alias("h_bad"))
    places = tree.where(F.size("steps") > 0).select("*", F.explode(F.sequence(F.lit(1), F.size("steps"))).alias("level"))
    others = F.transform("steps", lambda s, i: F.when(i + 1 == F.col("level"), "?").otherwise(s))
    places = places.withColumn("family", others)
    families = places.groupBy("host", "level", "family").agg(F.sum("labelled").alias("all_n"), F.sum("bad").alias("all_bad"))
    seen = places.join(families, ["host", "level", "family"]).groupBy("host", "steps").agg(F.sort_array(F.collect_list(F.struct("level", "all_n", "all_bad"))).alias("families"))  # LEVELS at most
    tree = tree.join(hosts, "host").join(seen, ["host", "steps"], "left")
    nothing = F.array().cast("array<struct<level:int,all_n:bigint,all_bad:bigint>>")

    def merged(p: Column, f: Column) -> Column:
        rest_n, rest_bad = f["all_n"] - F.col("labelled"), f["all_bad"] - F.col("bad")
        both = f["all_bad"] / F.nullif(f["all_n"], F.lit(0))
        own_n = F.nullif(F.col("labelled"), F.lit(0))
        gap = F.abs(F.col("bad") / own_n - rest_bad / F.nullif(rest_n, F.lit(0)))
        spread = F.sqrt(both * (1 - both) * (1 / own_n + 1 / F.nullif(rest_n, F.lit(0))))
        return F.when(F.coalesce(gap <= Z_LIMIT * spread, F.lit(True)), (f["all_bad"] + STRENGTH * p) / (f["all_n"] + STRENGTH)).otherwise(p)

    host = (F.col("h_bad") + STRENGTH * PRIOR) / (F.col("h_labelled") + STRENGTH)
    wider = F.aggregate(F.coalesce("families", nothing), host, merged)
    return tree.select("host", "steps", F.round((F.col("bad") + STRENGTH * wider) / (F.col("labelled") + STRENGTH), 9).alias("purity"))


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every page (page_id, url)."""
    rows = input_columns(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules)).withColumn("shape", shape_of(F.col("path")))
    bad = (F.col("ruled.verdict") == "block").cast("long")
    shapes = rows.groupBy("host", "shape").agg(F.count("*").alias("pages"), F.count(bad).alias("labelled"), F.coalesce(F.sum(bad), F.lit(0)).alias("bad"))
    found = templates(save(shapes, "url-shapes"))
    tree = save(found.join(purities(found), ["host", "steps"]).select("host", "shape", F.concat(F.lit("/"), F.array_join("steps", "/")).alias("template"), "purity"), "url-purity")
    own = F.when(F.col("purity") >= BAD_SHARE, "block").otherwise("allow")
    judged = rows.join(tree, ["host", "shape"])
    return judged.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce(F.col("ruled.verdict"), own).alias("verdict"), "template", "purity")


def _oracle() -> str:
    """The definition in DuckDB's SQL: every page by itself, every level in turn."""
    wild = "'*' || lower(regexp_extract({0}, '(\\.[A-Za-z]{{1,5}})$', 1))"
    sql = f"""
WITH s0 AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s1 AS (
  SELECT row_number() OVER () AS row, page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM s0),
s2 AS (
  SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS every, CASE
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule FROM s1),
t0 AS (
  SELECT row, page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 1 WHEN rule IS NOT NULL THEN 0 END AS bad, []::VARCHAR[] AS steps,
    CASE WHEN len(every) > {LEVELS} THEN list_append(every[1:{LEVELS - 1}], array_to_string(every[{LEVELS}:], '/')) ELSE every END AS segs FROM s2),"""
    for k in range(1, LEVELS + 1):
        sql += f"""
g{k} AS (SELECT *, segs[{k}] AS seg, regexp_matches(segs[{k}], '[0-9]') OR prefix(segs[{k}], '*') AS digits FROM t{k - 1}),
n{k} AS (SELECT host, steps, count(*) >= {LEAST_PAGES} AND count(DISTINCT seg) >= {VARIES} * count(*) AS varies FROM g{k} WHERE NOT digits GROUP BY ALL),
t{k} AS (SELECT row, page_id, host, path, rule, bad, segs, CASE WHEN seg IS NULL THEN steps WHEN digits OR coalesce(varies, false) THEN list_append(steps, {wild.format("seg")}) ELSE list_append(steps, seg) END AS steps
  FROM g{k} LEFT JOIN n{k} USING (host, steps)),"""
    sql += f"""
u AS (SELECT host, steps, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS k FROM t{LEVELS} GROUP BY ALL),
p0 AS (SELECT *, (sum(k) OVER w + {STRENGTH}::DOUBLE * {PRIOR}::DOUBLE) / (sum(n) OVER w + {STRENGTH}::DOUBLE) AS p FROM u WINDOW w AS (PARTITION BY host)),"""
    for k in range(1, LEVELS + 1):
        sql += f"""
f{k} AS (SELECT host, steps, n, k, p, sum(n) OVER w AS an, sum(k) OVER w AS ak FROM p{k - 1} WINDOW w AS (PARTITION BY host, list_concat(steps[:{k - 1}], ['?'], steps[{k + 1}:]), len(steps))),
p{k} AS (SELECT host, steps, n, k, CASE WHEN len(steps) >= {k} AND coalesce(abs(k / nullif(n, 0)::DOUBLE - (ak - k) / nullif(an - n, 0)::DOUBLE)
    <= {Z_LIMIT} * sqrt(ak / nullif(an, 0)::DOUBLE * (1 - ak / nullif(an, 0)::DOUBLE) * (1 / nullif(n, 0)::DOUBLE + 1 / nullif(an - n, 0)::DOUBLE)), true)
  THEN (ak + {STRENGTH}::DOUBLE * p) / (an + {STRENGTH}::DOUBLE) ELSE p END AS p FROM f{k}),"""
    return sql + f"""
z AS (SELECT host, steps, round((k + {STRENGTH}::DOUBLE * p) / (n + {STRENGTH}::DOUBLE), 9) AS purity FROM p{LEVELS})
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN purity >= {BAD_SHARE} THEN 'block' ELSE 'allow' END AS verdict, '/' || array_to_string(steps, '/') AS template, purity
FROM t{LEVELS} JOIN z USING (host, steps)
"""


ORACLE_SQL = _oracle()

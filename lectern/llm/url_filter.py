"""URL filtering by rules and by a tree of path templates for each host.

A path is a row of segments. Level by level, down to the last segment of the deepest path, a place
whose segments are nearly all different becomes a wildcard; among the branches that stay, those
whose share of bad labelled pages does not differ from their siblings' by a two-proportion test are
merged into a wildcard as well. Each template is then judged by its share of bad pages, smoothed
towards its host's share, which is smoothed towards that of all pages. Joins spread keys that many
rows have over several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: (host, path, verdict): a rule holds for its host and all subdomains where the path starts with its path.
RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
#: A key of over one in HOT of all pages is spread in joins, so that fewer than HOT keys are broadcast for it.
HOT = 1000
#: A place is variable with at least so many different segments, and this share of its pages.
KINDS, VARIETY = 8, 0.3
#: Branches whose shares differ by less than this many standard errors are merged.
SIMILAR = 1.96
PRIOR, REJECT = 10.0, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path; both empty for a null url or one without `://`."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    return (
        pages.select(F.col(id_col).alias("page_id"), rest.alias("rest"))
        .withColumn("raw", F.regexp_extract("rest", "^[^/?#]*", 0))
        .select("page_id", F.translate("raw", _UPPER, _LOWER).alias("host"), F.regexp_extract(F.substring("rest", F.length("raw") + 1, F.length("rest")), "^[^?#]*", 0).alias("path"))
    )


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits, or null."""
    fits = []
    for h, p, verdict in rules:
        fit = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        fits.append(F.when(fit, F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], weight: str, share: int) -> DataFrame:
    """`big` with the row of `small` for its keys; every key is there once, with the number of `big`'s rows as `weight`.

    A key of over `share` rows is dealt to as many tasks as it has shares, by a hash of the whole row,
    so that a stage that runs again deals it the same way.
    """
    hot = small.where(F.col(weight) > share).select(*keys, F.ceil(F.col(weight) / share).cast("int").alias("_parts"))
    dealt = big.join(F.broadcast(hot), keys, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*big.columns), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    copies = F.sequence(F.lit(0), F.when(F.col(weight) > share, F.ceil(F.col(weight) / share).cast("int") - 1).otherwise(F.lit(0)))
    return dealt.join(small.withColumn("_part", F.explode(copies)).drop(weight), [*keys, "_part"]).drop("_part")


def templates(paths: DataFrame, share: int, kinds: int = KINDS, variety: float = VARIETY, similar: float = SIMILAR) -> DataFrame:
    """(host, path, n, labelled, bad) with its template; one row for each host and path.

    One round for each level; a path ends with its last segment, or where no other path shares its
    template any more, because what follows is then kept as it is.
    """
    tree = paths.withColumn("left", F.array_remove(F.split("path", "/"), "")).withColumn("template", F.lit(""))
    done = []
    while True:
        tree = written(tree, "url-tree")  # read several times at the next level
        done.append(tree.where(F.size("left") == 0).drop("left"))
        open_ = tree.where(F.size("left") > 0).withColumn("segment", F.get("left", F.lit(0)))
        if open_.isEmpty():
            break
        branch = open_.groupBy("host", "template", "segment").agg(F.sum("n").alias("b_n"), F.sum("labelled").alias("b_lab"), F.sum("bad").alias("b_bad"), F.count("*").alias("b_paths"))
        node = branch.groupBy("host", "template").agg(F.count("*").alias("kinds"), F.sum("b_n").alias("t_n"), F.sum("b_lab").alias("t_lab"), F.sum("b_bad").alias("t_bad"), F.sum("b_paths").alias("t_paths"))
        both = spread_join(branch, node.withColumn("_kinds", F.col("kinds")), ["host", "template"], "_kinds", share)
        variable = (F.col("kinds") >= kinds) & (F.col("kinds") >= variety * F.col("t_n"))
        others = F.col("t_lab") - F.col("b_lab")
        p = F.try_divide("t_bad", "t_lab")
        apart = F.abs(F.try_divide("b_bad", "b_lab") - F.try_divide(F.col("t_bad") - F.col("b_bad"), others))
        error = F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1.0), "b_lab") + F.try_divide(F.lit(1.0), others)))
        alike = ~F.coalesce(apart >= similar * error, F.lit(False)) | F.coalesce(error == 0, F.lit(True))
        star = variable | ((F.col("kinds") > 1) & alike)
        named = both.select("host", "template", "segment", F.when(star, F.lit("*")).otherwise(F.col("segment")).alias("part"), (F.col("t_paths") == 1).alias("alone"), "b_paths")
        rest = F.slice("left", F.lit(2), F.size("left"))
        tree = (
            spread_join(open_, written(named, "url-branches"), ["host", "template", "segment"], "b_paths", share)
            .withColumn("template", F.concat("template", F.lit("/"), F.when(F.col("alone"), F.array_join("left", "/")).otherwise(F.col("part"))))
            .withColumn("left", F.when(F.col("alone"), F.array().cast("array<string>")).otherwise(rest))
            .drop("part", "segment", "alone")
        )
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", label_id_col: str = "page_id", bad_col: str = "bad", prior: float = PRIOR, reject: float = REJECT) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every page.

    `labels` holds (page_id, bad); of several labels of one page bad wins, null labels are ignored.
    purity is the smoothed share of bad pages of the template; at `reject` and above the template is
    rejected. A rule's verdict comes first; no two rules that fit a page are equally long, since both
    would be the same one. A null url or one without `://` has an empty host and path, with a
    template of its own. Repeated rows and null ids stay; an empty table gives none. Paths of any
    length are read to their end; other columns are not read.
    """
    marks = labels.where(F.col(bad_col).isNotNull() & F.col(label_id_col).isNotNull()).groupBy(F.col(label_id_col).alias("l_id")).agg(F.max(F.col(bad_col).cast("int")).alias("mark"))
    seen = parsed(pages, id_col, url_col)
    known = seen.where("page_id is not null")
    marked = known.join(marks, known.page_id == marks.l_id, "left").select("host", "path", "mark").unionAll(seen.where("page_id is null").select("host", "path", F.lit(None).cast("int")))
    paths = written(marked.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("mark").alias("labelled"), F.coalesce(F.sum("mark"), F.lit(0)).alias("bad")), "url-paths")
    all_ = paths.agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).first()
    share, base = max(1, (all_.n or 0) // HOT), F.lit(all_.bad / all_.labelled if all_.labelled else 0.0)
    tree = written(templates(paths, share), "url-templates")
    of_host = paths.groupBy("host").agg(F.sum("labelled").alias("h_lab"), F.sum("bad").alias("h_bad"), F.count("*").alias("h_paths"))
    of_template = tree.groupBy("host", "template").agg(F.sum("labelled").alias("t_lab"), F.sum("bad").alias("t_bad"), F.count("*").alias("t_paths"))
    host_share = (F.col("h_bad") + prior * base) / (F.col("h_lab") + prior)
    purity = spread_join(of_template, of_host, ["host"], "h_paths", share).select("host", "template", ((F.col("t_bad") + prior * host_share) / (F.col("t_lab") + prior)).alias("purity"), "t_paths")
    judged = spread_join(tree.select("host", "path", "template", "n"), written(purity, "url-purity"), ["host", "template"], "t_paths", share)
    out = spread_join(seen, written(judged, "url-judged"), ["host", "path"], "n", share).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("fit.verdict", F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def oracle() -> str:
    """The same in DuckDB SQL, for page labels from `labels` (bad: low quality or toxic)."""
    longest = ", ".join(f"CASE WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'length': {len(h + p)}, 'rule': '{h + p}', 'verdict': '{v}'}} END" for h, p, v in RULES)
    return f"""WITH RECURSIVE u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
r AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
seen AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM r),
marks AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS mark FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
paths AS (SELECT host, path, count(*)::bigint AS n, count(mark)::bigint AS labelled, coalesce(sum(mark), 0)::bigint AS bad FROM seen LEFT JOIN marks ON page_id = doc_id GROUP BY 1, 2),
grown AS (SELECT host, path, n, labelled, bad, list_filter(string_split(path, '/'), lambda x: x <> '') AS segments, 0 AS d, '' AS template FROM paths
UNION ALL SELECT host, path, n, labelled, bad, segments, d + 1, template || '/' || CASE WHEN (kinds >= {KINDS} AND kinds >= {VARIETY}::double * t_n) OR (kinds > 1 AND (NOT coalesce(apart >= {SIMILAR}::double * error, false) OR coalesce(error = 0, true))) THEN '*' ELSE segment END FROM
  (SELECT *, abs(b_bad / nullif(b_lab, 0) - (t_bad - b_bad) / nullif(t_lab - b_lab, 0)) AS apart,
     sqrt((t_bad / nullif(t_lab, 0)) * (1 - t_bad / nullif(t_lab, 0)) * (1.0::double / nullif(b_lab, 0) + 1.0::double / nullif(t_lab - b_lab, 0))) AS error FROM
   (SELECT *, max(nth) OVER node AS kinds, sum(n) OVER node AS t_n, sum(labelled) OVER node AS t_lab, sum(bad) OVER node AS t_bad, sum(labelled) OVER branch AS b_lab, sum(bad) OVER branch AS b_bad FROM
    (SELECT *, segments[d + 1] AS segment, dense_rank() OVER (PARTITION BY host, template ORDER BY segments[d + 1]) AS nth FROM grown WHERE len(segments) > d)
    WINDOW node AS (PARTITION BY host, template), branch AS (PARTITION BY host, template, segment)))),
tree AS (SELECT host, path, labelled, bad, template FROM grown WHERE len(segments) = d),
hosts AS (SELECT host, sum(labelled) AS h_lab, sum(bad) AS h_bad FROM paths GROUP BY 1),
base AS (SELECT coalesce(sum(bad) / nullif(sum(labelled), 0), 0) AS base FROM paths),
per_template AS (SELECT host, template, sum(labelled) AS t_lab, sum(bad) AS t_bad FROM tree GROUP BY ALL),
judged AS (SELECT host, template, (t_bad + {PRIOR}::double * ((h_bad + {PRIOR}::double * base) / (h_lab + {PRIOR}::double))) / (t_lab + {PRIOR}::double) AS purity FROM per_template JOIN hosts USING (host), base),
fit AS (SELECT page_id, host, path, list_max(list_filter([{longest}], lambda x: x IS NOT NULL)) AS f FROM seen)
SELECT page_id, fit.host, fit.path, f.rule AS rule, coalesce(f.verdict, CASE WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, tree.template, round(purity, 6) AS purity
FROM fit JOIN tree ON fit.host = tree.host AND fit.path = tree.path JOIN judged ON tree.host = judged.host AND tree.template = judged.template"""

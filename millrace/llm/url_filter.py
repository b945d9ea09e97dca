"""URL filters (operator 2): allow and block rules, and a path-template tree for what no rule fits.

Per host, segments that look variable (numbers, hexadecimal, dates, names with digits) become wildcards that keep a
file's extension; so do rare segments below a node with many children. Then, level by level, sibling branches are merged
that statistics can't tell apart: a G-test finds no difference between the distributions of what lies below them, or the
difference is small in itself, and where both have labels a G-test finds none between their label rates either.

The rules label the URLs that they fit. A template's purity is its share of blocked labels, smoothed towards that of
the same template over all hosts of the domain, and that one towards the share of all labels. Merged branches have no
name in common: one counts with those in its place on other hosts if the same tests hold it alike to the sum of the
labelled ones, and else has its own labels alone. A template is rejected when domain and host gave it enough labels and
its purity is high enough, so an unruled URL is blocked where it belongs to a template whose ruled URLs are blocked.

All counts are pre-aggregated by host and template, so a host with a third of all pages is no larger than others. A
merge compares at most CHILDREN or 1 / RARE siblings, each with a histogram of BINS counts.

Edge cases: a null URL, or one without ``://``, has empty host and path and is allowed; ports and user names stay part of
the host; an empty path fits no rule; segments deeper than DEPTH share one wildcard, however many there are; null ids are
carried; repeated rows and repeated URLs count each; an empty table gives an empty result; only id and URL are read.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from millrace.storage import Workspace, scratch

#: Fixed values: (verdict, host, path) of each rule.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Segments that are kept apart (deeper ones share one wildcard), children from which rare segments are wildcards, their
#: largest share, bins of a branch's histogram.
DEPTH, CHILDREN, RARE, BINS = 8, 24, 0.02, 32
#: Merging: normal quantile of the tests (1 % of equal branches are kept apart), rows that either branch needs for the
#: test of shapes, Jensen-Shannon divergence (bits) that is small in itself.
QUANTILE, LEAST_ROWS, SMALL = 2.326, 8, 0.02
#: Pseudo-labels of the smoothing, least labels and least purity of a rejected template, host labels that name a domain.
SMOOTHING, LEAST_LABELS, PURITY, DOMAIN = 4.0, 5, 0.8, 2
VARIABLE = r"^(?:[0-9][0-9._,-]*|[0-9A-Fa-f]{8,}|[0-9A-Fa-f]{8}-[0-9A-Fa-f-]{27}|(?=[^/]*[0-9][^/]*[0-9][^/]*[0-9])[A-Za-z0-9_~%=+.-]+)$"
EXTENSION = r"[^.]\.([A-Za-z]{2,5})$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys of a branch.
AT = ["host", "node", "seg"]

def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tried first
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def shape(path_: Column, depth: int = DEPTH) -> Column:
    """Segments of a path with the variable ones as wildcards; what lies deeper than ``depth`` is one more wildcard."""
    segments = F.filter(F.split(path_, "/"), lambda s: s != "")
    ending = lambda s: F.when(s.rlike(EXTENSION), F.concat(F.lit("*."), F.lower(F.regexp_extract(s, EXTENSION, 1)))).otherwise("*")
    general = F.transform(segments, lambda s: F.when(s.rlike(VARIABLE), ending(s)).otherwise(s))
    return F.when(F.size(general) > depth, F.concat(F.slice(general, 1, depth), F.array(F.lit("**")))).otherwise(general)


def domain(host_: Column) -> Column:
    return F.substring_index(host_, ".", -DOMAIN)


def _at(templates: DataFrame, level: int) -> DataFrame:
    """Adds the node above segment ``level`` (from 0) of ``t``, and the segment, null where ``t`` is shorter."""
    node = F.array_join(F.slice("t", 1, level), "/") if level else F.lit("")
    return templates.withColumn("node", node).withColumn("seg", F.get("t", F.lit(level)))


def _renamed(keyed: DataFrame, names: DataFrame, level: int) -> DataFrame:
    """Puts ``name`` in the place of segment ``level`` where ``names`` (host, node, seg, name) has one."""
    changed = F.when(F.col("name").isNotNull(), F.concat(F.slice("t", 1, level), F.array("name"), F.slice("t", level + 2, DEPTH + 1))).otherwise(F.col("t"))
    return keyed.join(names, AT, "left").select("host", "leaf", changed.alias("t"), "n", "blocked", "labelled")


def _wildcards(templates: DataFrame, level: int, ws: Workspace) -> DataFrame:
    """Rare segments of nodes with many children become wildcards at this level."""
    keyed = _at(templates, level)
    counts = ws.save(keyed.where("seg is not null").groupBy(*AT).agg(F.sum("n").alias("c")), f"children{level}")
    nodes = counts.groupBy("host", "node").agg(F.count("*").alias("k"), F.sum("c").alias("all"))
    rare = counts.join(nodes, ["host", "node"]).where((F.col("k") >= CHILDREN) & (F.col("c") < RARE * F.col("all")) & (F.col("seg") != "*"))
    return ws.save(_renamed(keyed, rare.select(*AT, F.lit("*").alias("name")), level), f"wild{level}")


def critical(df: int, z: float = QUANTILE) -> float:
    """Upper quantile of the chi-squared distribution (Wilson and Hilferty's approximation)."""
    return df * (1 - 2 / (9 * df) + z * math.sqrt(2 / (9 * df))) ** 3


def divergence(p: list[float], q: list[float]) -> tuple[float, int]:
    """G statistic of two rows of counts, and its degrees of freedom."""
    a, b = sum(p), sum(q)
    g, cells = 0.0, 0
    for x, y in zip(p, q, strict=True):
        if x + y:
            cells += 1
            g += sum(2 * v * math.log(v * (a + b) / (t * (x + y))) for v, t in ((x, a), (y, b)) if v)
    return max(0.0, g), max(1, cells - 1)


def alike(p: dict, q: dict) -> bool:
    """Whether two branches (n, b, l and the histogram) are to be one."""
    g, df = divergence(p["hist"], q["hist"])
    a, b = p["n"], q["n"]
    if not (min(a, b) >= LEAST_ROWS and g <= critical(df)):
        # the divergence of the two distributions, each with half the weight
        even = divergence([x / a for x in p["hist"]], [y / b for y in q["hist"]])[0] / (4 * math.log(2))
        if even > SMALL:
            return False
    if not p["l"] or not q["l"]:
        return True
    return divergence([p["b"], p["l"] - p["b"]], [q["b"], q["l"] - q["b"]])[0] <= critical(1)


def merged_names(branches: list[dict]) -> dict[str, str]:
    """New names of a node's branches: in order of size, each joins the first cluster that it is like, else starts one."""
    clusters: list[tuple[dict, list[str]]] = []
    for x in sorted(branches, key=lambda x: (-x["n"], x["seg"])):
        for total, segs in clusters:
            if alike(total, x):
                segs.append(x["seg"])
                for k in ("n", "b", "l"):
                    total[k] += x[k]
                total["hist"] = [u + v for u, v in zip(total["hist"], x["hist"], strict=True)]
                break
        else:
            clusters.append(({k: x[k] for k in ("n", "b", "l", "hist")}, [x["seg"]]))
    return {seg: "~" + min(segs) for _, segs in clusters if len(segs) > 1 for seg in segs}


def _merged(templates: DataFrame, level: int, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Branches of a node that ``alike`` holds for get one name, the least of theirs after a tilde; and ``_pooled`` of them."""

    @F.pandas_udf("array<struct<seg:string,name:string>>")
    def names(groups: pd.Series) -> pd.Series:
        out = []
        for group in groups:
            branches = []
            for x in group:
                branches.append({"seg": x["seg"], "n": x["n"], "b": x["b"], "l": x["l"], "hist": _hist(x["cells"])})
            out.append([{"seg": k, "name": v} for k, v in merged_names(branches).items()])
        return pd.Series(out)

    keyed = _at(templates, level)
    below = F.pmod(F.xxhash64(F.array_join(F.slice("t", level + 2, DEPTH + 1), "/")), F.lit(BINS)).cast("int")
    cells = keyed.where("seg is not null").groupBy(*AT, below.alias("bin")).agg(F.sum("n").alias("c"), F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
    branches = cells.groupBy(*AT).agg(F.sum("c").alias("n"), F.sum("b").alias("b"), F.sum("l").alias("l"), F.collect_list(F.struct("bin", "c")).alias("cells"))
    nodes = branches.groupBy("host", "node").agg(F.collect_list(F.struct("seg", "n", "b", "l", "cells")).alias("group")).where("size(group) > 1")
    found = nodes.select("host", "node", F.explode(names("group")).alias("x")).select("host", "node", "x.seg", "x.name")
    found = ws.save(found, f"names{level}")
    return ws.save(_renamed(keyed, found, level), f"merged{level}"), ws.save(_pooled(cells, found), f"pooled{level}")


def _hist(cells: list[dict]) -> list[float]:
    hist = [0.0] * BINS
    for cell in cells:
        hist[cell["bin"]] = float(cell["c"])
    return hist


def _general(t: Column) -> Column:
    """A template with every merged branch as ``~``."""
    return F.array_join(F.transform(t, lambda s: F.when(s.startswith("~"), "~").otherwise(s)), "/")


def _pooled(cells: DataFrame, names: DataFrame) -> DataFrame:
    """``host, node, name, pooled``: whether a merged branch is like the sum of the labelled ones in its place on all hosts of
    the domain. ``cells`` are the histograms that it was merged by; one pair of sums is compared a branch."""
    place = ["domain", "under"]
    named = cells.join(names, AT).withColumns({"domain": domain(F.col("host")), "under": _general(F.split("node", "/"))})
    cells = named.groupBy(*place, "host", "node", "name", "bin").agg(*[F.sum(c).alias(c) for c in "cbl"])
    add = [F.sum("c").alias("n"), F.sum("b").alias("b"), F.sum("l").alias("l"), F.collect_list(F.struct("bin", "c")).alias("cells")]
    branches = cells.groupBy(*place, "host", "node", "name").agg(*add)
    labelled = branches.where("l > 0").select("host", "node", "name")
    summed = cells.join(labelled, ["host", "node", "name"], "left_semi").groupBy(*place, "bin").agg(*[F.sum(c).alias(c) for c in "cbl"])

    @F.pandas_udf("boolean")
    def like(one: pd.DataFrame, other: pd.DataFrame) -> pd.Series:
        counts = lambda x: {"n": x.n, "b": x.b, "l": x.l, "hist": _hist(x.cells)}
        return pd.Series([alike(counts(a), counts(b)) for a, b in zip(one.itertuples(), other.itertuples(), strict=True)], dtype=bool)

    row = lambda x: F.struct(*[F.col(f"{x}.{c}").alias(c) for c in ("n", "b", "l", "cells")])
    return branches.alias("x").join(summed.groupBy(*place).agg(*add).alias("y"), place).select("host", "node", "name", like(row("y"), row("x")).alias("pooled"))


def templates(urls: DataFrame, ws: Workspace) -> DataFrame:
    """From ``host, path, label`` (1 block, 0 allow, null): ``host, leaf, template, purity, rejected``; ``leaf`` is the
    path's shape before the tree generalised it."""
    leaf = F.array_join(shape(F.col("path")), "/")
    start = urls.groupBy("host", leaf.alias("leaf")).agg(F.count("*").alias("n"), F.sum(F.coalesce("label", F.lit(0))).cast("double").alias("blocked"), F.count("label").cast("double").alias("labelled"))
    now = ws.save(start.withColumn("t", F.when(F.col("leaf") == "", F.array().cast("array<string>")).otherwise(F.split("leaf", "/"))), "shapes")
    deepest = now.agg(F.max(F.size("t"))).first()[0] or 0
    for level in range(deepest):
        now = _wildcards(now, level, ws)
    pools = []
    for level in range(deepest):
        now, pool = _merged(now, level, ws)
        pools.append(pool)
    # labels are shared where every merged branch on the way may share them
    now = now.withColumns({"template": F.array_join("t", "/"), "form": _general(F.col("t")), "domain": domain(F.col("host")), "shared": F.lit(True)})
    for level, pool in enumerate(pools):
        fine = ~F.coalesce(F.get("t", F.lit(level)).startswith("~"), F.lit(False)) | F.coalesce("pooled", F.lit(False))
        here = _at(now, level).join(pool.withColumnRenamed("name", "seg"), AT, "left")
        now = here.withColumn("shared", F.col("shared") & fine).drop("node", "seg", "pooled")
    now = ws.save(now, "named")
    every = now.agg(F.sum("blocked"), F.sum("labelled")).first()
    prior = ((every[0] or 0.0) + 1) / ((every[1] or 0.0) + 2)
    smoothed = lambda b, n, towards: (F.col(b) + SMOOTHING * towards) / (F.col(n) + SMOOTHING)
    own = ws.save(now.groupBy("host", "domain", "template", "form", "shared").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")), "sums")
    wide = own.where("shared").groupBy("domain", "form").agg(F.sum("b").alias("sb"), F.sum("l").alias("sl"))
    both = own.join(wide, ["domain", "form"], "left").withColumns({f"d{c}": F.when(F.col("shared"), F.col(f"s{c}")).otherwise(F.col(c)) for c in "bl"})
    purity = smoothed("b", "l", smoothed("db", "dl", F.lit(prior)))
    judged = both.select("host", "template", purity.alias("purity"), ((F.col("dl") >= LEAST_LABELS) & (purity >= PURITY)).alias("rejected"))
    return ws.save(now.join(judged, ["host", "template"]).select("host", "leaf", "template", "purity", "rejected"), "templates")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, workspace: Workspace | None = None) -> DataFrame:
    """``id, host, path, rule, verdict, template, purity`` for every row."""
    ws = scratch(pages.sparkSession, "urls", workspace)
    parsed = pages.select(F.col(id_col).alias("id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled = ws.save(parsed.withColumn("rule", rule).withColumn("by_rule", verdict).withColumn("leaf", F.array_join(shape(F.col("path")), "/")), "ruled")
    label = F.when(F.col("by_rule") == "block", 1).when(F.col("by_rule") == "allow", 0)
    tree = templates(ruled.select("host", "path", label.alias("label")), ws)
    ws.keep(ruled, tree)
    by_tree = F.when(F.col("rejected") & (F.col("host") != ""), F.lit("block")).otherwise(F.lit("allow"))
    joined = ruled.join(tree, ["host", "leaf"], "left")
    return joined.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", by_tree).alias("verdict"), "template", "purity")


def op2(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))

"""URL filters by a path-template tree. DataFrame expressions only: no Python runs on executors.

A url's path is cut into segments; digits and hashes inside a segment become placeholders, and
where a place in a host's tree has more than ``fanout`` different children, the thin ones become
``*``. Urls that a rule decides are the labelled ones. Sibling branches whose blocked share does
not differ significantly from that of their parent are merged and judged by their joint counts;
a template's purity is its smoothed share of allowed urls, each level shrunk towards the one above.
A template whose purity is under ``threshold`` is rejected.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and
is judged as the template of the empty host. What is behind the first ``max_depth`` segments is one segment, whole.
Repeated rows are judged alike; an empty table gives an empty one; other columns pass
through, and one named ``url_filter`` is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the registered query.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def segments(path: Column, max_depth: int) -> Column:
    """The path's segments with placeholders for what varies by its form."""

    def shape(s: Column) -> Column:
        s = F.lower(s)
        s = F.regexp_replace(s, r"^(?=.*[0-9])[0-9a-f]{8,}(-[0-9a-f]+)*$", "{h}")
        return F.regexp_replace(s, r"[0-9]+", "{n}")

    parts = F.split(F.regexp_replace(path, r"^/", ""), "/", -1)
    forms = F.transform(parts, shape)
    short = F.slice(forms, 1, max_depth)
    rest = F.array_join(F.slice(forms, max_depth + 1, F.size(forms)), "/")
    return F.when(F.size(parts) > max_depth, F.concat(short, F.array(rest))).otherwise(short)


def judge_urls(
    df: DataFrame,
    url: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    max_depth: int = 8,
    fanout: int = 40,
    alpha: float = 4.0,
    prior: float = 0.8,
    threshold: float = 0.5,
    z: float = 1.96,
) -> DataFrame:
    """df with struct column ``url_filter``: host, path, rule, verdict, template, purity."""
    u = F.col(url)
    t_host, t_leaf, t_template, t_purity = fresh(df, "t_host", "t_leaf", "t_template", "t_purity")
    rows = df.withColumn("url_filter", F.struct(host_of(u).alias("host"), path_of(u).alias("path")))
    host, path = F.col("url_filter.host"), F.col("url_filter.path")
    rows = rows.withColumn("url_filter", F.struct(host.alias("host"), path.alias("path"), rule_of(host, path, rules).alias("r"), segments(path, max_depth).alias("segs")))

    # leaves of the trees: one row for each host and form of path, counted before any shuffle
    lone = F.array_join("segs", "/").alias("leaf")
    leaf = rows.select("url_filter.*").groupBy("host", "segs").agg(
        F.count("*").alias("n"), F.count("r").alias("m"), F.count_if(F.col("r.verdict") == "allow").alias("good")
    )
    leaf = stage(leaf.select("host", lone, "segs", "n", "m", "good"), "urls")
    depth = leaf.agg(F.max(F.size("segs"))).first()[0] or 1

    # generalise, from the root down
    for at in range(1, depth + 1):
        parent = F.array_join(F.slice("segs", 1, at - 1), "/") if at > 1 else F.lit("")
        here = leaf.withColumn("parent", parent).withColumn("child", F.get("segs", F.lit(at - 1)))
        kids = here.where("child is not null").groupBy("host", "parent", "child").agg(F.sum("n").alias("kn"))
        wide = kids.groupBy("host", "parent").agg(F.count("*").alias("kids"), F.sum("kn").alias("pn")).where(F.col("kids") > fanout)
        thin = kids.join(wide, ["host", "parent"]).where("kn * 10 < pn").select("host", "parent", "child", F.lit(True).alias("thin"))
        new = F.when(F.col("thin"), F.concat(F.slice("segs", 1, at - 1) if at > 1 else F.array().cast("array<string>"), F.array(F.lit("*")), F.slice("segs", at + 1, max_depth + 2))).otherwise(F.col("segs"))
        # each level is written: a level reads the one above three times, which would multiply with the depth
        leaf = stage(here.join(thin, ["host", "parent", "child"], "left").withColumn("segs", new).select("host", "leaf", "segs", "n", "m", "good"), "urls")

    # counts of every node, its parent, and of the siblings that are like their parent
    ways = F.transform(F.sequence(F.lit(1), F.size("segs")), lambda i: F.struct(i.alias("lev"), F.array_join(F.slice("segs", 1, i), "/").alias("node"), F.array_join(F.slice("segs", 1, i - 1), "/").alias("up")))
    paths = leaf.select("host", "leaf", "m", "good", F.explode(ways).alias("w")).select("host", "leaf", "m", "good", "w.*")
    node = paths.groupBy("host", "lev", "node", "up").agg(F.sum("m").alias("m"), F.sum("good").alias("good"))
    over = node.groupBy("host", "lev", "up").agg(F.sum("m").alias("pm"), F.sum("good").alias("pg"))
    share = (F.col("pg") + 0.5) / (F.col("pm") + 1)
    apart = F.abs(F.col("good") - F.col("m") * share) / F.sqrt(F.col("m") * share * (1 - share))
    node = node.join(over, ["host", "lev", "up"]).withColumn("alike", (F.col("m") > 0) & (apart <= z))
    joint = node.where("alike").groupBy("host", "lev", "up").agg(F.sum("m").alias("jm"), F.sum("good").alias("jg"))
    node = node.join(joint, ["host", "lev", "up"], "left").select(
        "host", "lev", "node",
        F.when(F.col("alike"), F.col("jm")).otherwise(F.col("m")).alias("m"),
        F.when(F.col("alike"), F.col("jg")).otherwise(F.col("good")).alias("good"),
    )
    chain = paths.select("host", "leaf", "lev", "node").join(node, ["host", "lev", "node"]).groupBy("host", "leaf").agg(
        F.sort_array(F.collect_list(F.struct("lev", "m", "good", "node"))).alias("c")
    )
    purity = F.aggregate("c", F.lit(prior), lambda p, x: (x["good"] + alpha * p) / (x["m"] + alpha))
    verdicts = chain.select(F.col("host").alias(t_host), F.col("leaf").alias(t_leaf), F.element_at("c", -1)["node"].alias(t_template), purity.alias(t_purity))

    out = rows.withColumns({t_host: host, t_leaf: F.array_join("url_filter.segs", "/")}).join(verdicts, [t_host, t_leaf], "left")
    made = F.when(F.col(t_purity) < threshold, "block").otherwise("allow")
    return out.withColumn(
        "url_filter",
        F.struct(
            host.alias("host"), path.alias("path"), F.col("url_filter.r.rule").alias("rule"),
            F.coalesce(F.col("url_filter.r.verdict"), made).alias("verdict"),
            F.col(t_template).alias("template"), F.col(t_purity).alias("purity"),
        ),
    ).drop(t_host, t_leaf, t_template, t_purity)


def rule_condition(rules: Sequence[tuple[str, str]], host: str = "host", path: str = "path") -> str:
    """The same rule choice as a SQL CASE, longest first."""
    arms = []
    for _, rule in sorted(rules, key=lambda r: -len(r[1])):
        h, slash, p = rule.partition("/")
        arms.append(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{slash}{p}') THEN '{rule}'")
    return reduce(lambda a, b: f"{a} {b}", arms, "CASE") + " END"

"""URL filter over a tree of path templates.

Rules judge the urls that they fit, the longest one first, and those verdicts label the
tree. Per host the tree is generalised level by level, down to the last segment:

* segments that vary become a wildcard, ``#``: those with a digit, and, where a node has many
  children mostly seen once, those seen once;
* branches of a node that are alike become one, ``#`` and its least name. Labelled branches
  are split by whether most of their labels block; one joins its side if a two-sample test
  does not tell its share of blocked labels from that of the side's others. A branch without
  labels joins the side whose branches have just its own named children, two or more: it is a
  twin in structure. Nothing else says anything about it.

A template's purity is its share of blocked labels, smoothed towards that of the template
above it where labels there are of both kinds, and towards a half elsewhere: a node all of
whose labels agree does not speak for children without labels. Templates whose purity
passes ``REJECT_ABOVE`` are rejected.

Pages are aggregated to templates before any shuffle; tree work runs on templates, and each
level of the tree is written, so that plans stay small. A path leaves the loop once no other
shares its node, so there are as many rounds as two paths of a host have segments in common.

Defined cases: a null url or one without ``://`` has empty host and path and fits no rule;
hosts without labels are allowed; repeated urls each get their row, null ids too; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.scratch import stage

#: (verdict, host, path). Fixed values.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
WILD = "#"  #: no path holds one
MANY_CHILDREN, MOSTLY_ONCE, LEAST_KIDS = 16, 0.5, 2
Z = 1.96
PRIOR, PRIOR_WEIGHT = 0.5, 4.0
REJECT_ABOVE = 0.75


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), ascii_uppercase, ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, at, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        rule, verdict = F.when(fits, at + start).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """All segments of a path, wildcards for those with a digit."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.when(s.rlike("[0-9]"), WILD).otherwise(s))


def _named(segment: Column) -> Column:
    return ~segment.startswith(WILD)


def _alike(n: Column, blocked: Column, all_n: Column, all_blocked: Column) -> Column:
    """Whether a part of (all_n, all_blocked) does not differ from the rest by more than chance."""
    rest = all_n - n
    share, spread = all_blocked / all_n, 1 / n + 1 / rest
    apart = F.abs(blocked / n - (all_blocked - blocked) / rest)
    return F.when(rest > 0, apart <= Z * F.sqrt(share * (1 - share) * spread) + spread / 2).otherwise(False)


def _names(at: DataFrame) -> DataFrame:
    """(host, above, here, name) of the branches that become a wildcard or join others."""
    key, node = ["host", "above", "here"], ["host", "above"]
    kids = at.where(F.col("below").isNotNull() & _named(F.col("below"))).select(*key, "below").distinct()
    kids = kids.groupBy(*key).agg(F.count("*").alias("kids"), F.bit_xor(F.xxhash64("below")).alias("form")).where(F.col("kids") >= LEAST_KIDS)
    branch = at.groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("urls", "labelled", "blocked")]).join(kids, key, "left")
    once = F.sum(F.when(F.col("urls") == 1, 1).otherwise(0))
    varied = branch.groupBy(*node).agg(F.count("*").alias("children"), once.alias("once")).where((F.col("children") >= MANY_CHILDREN) & (F.col("once") >= MOSTLY_ONCE * F.col("children")))
    named = branch.where(_named(F.col("here"))).join(varied.select(*node, F.lit(True).alias("varied")), node, "left")
    gone = F.coalesce(F.col("varied"), F.lit(False)) & (F.col("urls") == 1)
    wild = named.where(gone).select(*key, F.lit(WILD).alias("name"))

    stays = named.where(~gone).withColumn("side", F.when(F.col("labelled") > 0, F.col("blocked") > F.col("labelled") / 2))
    sides = stays.where("labelled > 0").groupBy(*node, "side").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b"))
    tested = stays.join(sides, [*node, "side"]).where(_alike(F.col("labelled"), F.col("blocked"), F.col("n"), F.col("b")))
    labelled = stays.where("labelled > 0")
    forms = labelled.where("form IS NOT NULL").groupBy(*node, "kids", "form").agg(F.min("side").alias("side"), F.max("side").alias("other")).where("side = other")
    twins = stays.where("labelled = 0").drop("side").join(forms, [*node, "kids", "form"])
    # a twin joins its side, and the branches that it is a twin of join with it
    pulled = labelled.join(twins.select(*node, "kids", "form").distinct(), [*node, "kids", "form"], "left_semi")
    members = tested.select(*key, "side").union(pulled.select(*key, "side")).union(twins.select(*key, "side")).distinct()
    least = members.groupBy(*node, "side").agg(F.min("here").alias("least"), F.count("*").alias("members")).where("members > 1")
    return wild.unionByName(members.join(least, [*node, "side"]).select(*key, F.concat(F.lit(WILD), F.col("least")).alias("name")))


def _shared(templates: DataFrame, level: int) -> DataFrame:
    """The templates that go on below ``level`` and share their node there with others."""
    deep = templates.where(F.size("tree") > level).withColumn("above", F.array_join(F.slice("tree", 1, level), "/"))
    many = deep.groupBy("host", "above").count().where("count > 1").select("host", "above")
    return deep.join(many, ["host", "above"], "left_semi")


def template_tree(urls: DataFrame) -> DataFrame:
    """(host, raw, tree, purity, labels) from rows of (host, raw, verdict); raw is a path with wildcards."""
    counted = urls.groupBy("host", "raw").agg(F.count("*").alias("urls"), F.count("verdict").alias("labelled"), F.sum(F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("blocked"))
    counted = stage(counted, "templates")
    started = counted.withColumn("tree", F.filter(F.split("raw", "/"), lambda s: s != ""))
    now, level, done = stage(_shared(started, 0), "tree"), 0, []
    changed = ["host", "raw", "urls", "labelled", "blocked", "tree"]
    while not now.isEmpty():
        at = now.withColumns({"here": F.get("tree", F.lit(level)), "below": F.get("tree", F.lit(level + 1))})
        own = F.concat(F.slice("tree", 1, level), F.array("name"), F.slice("tree", level + 2, F.size("tree")))
        named = at.join(_names(at), ["host", "above", "here"], "left").withColumn("tree", F.when(F.col("name").isNotNull(), own).otherwise(F.col("tree")))
        level += 1
        named = stage(named.select(*changed), "tree")
        done.append(named.withColumn("level", F.lit(level)))
        now = stage(_shared(named, level), "tree")
    last = ["host", "raw"]
    trees = started.select(*changed)
    if done:
        # a template's last round has its final form; one that took part in none keeps its own
        every = done[0]
        for d in done[1:]:
            every = every.unionByName(d)
        final = every.groupBy(*last).agg(F.max_by("tree", "level").alias("final"))
        trees = started.join(final, last, "left").withColumn("tree", F.coalesce("final", "tree")).select(*changed)
    return _with_purity(stage(trees, "tree"))


def _with_purity(trees: DataFrame) -> DataFrame:
    node = F.explode(F.transform(F.sequence(F.lit(0), F.size("tree")), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice("tree", F.lit(1), n), "/").alias("prefix"))))
    formed = trees.groupBy("host", "tree").agg(F.sum("labelled").alias("labels"), F.sum("blocked").alias("blocked"))
    above = stage(formed.select("host", "tree", "labels", "blocked", node.alias("node")).select("host", "tree", "labels", "blocked", "node.*"), "nodes")
    sums = above.groupBy("host", "depth", "prefix").agg(F.sum("labels").cast("double").alias("n"), F.sum("blocked").cast("double").alias("b"))
    chain = above.join(sums, ["host", "depth", "prefix"]).groupBy("host", "tree").agg(F.first("labels").alias("labels"), F.array_sort(F.collect_list(F.struct("depth", "n", "b"))).alias("chain"))
    start = F.struct(F.lit(PRIOR).alias("prior"), F.lit(PRIOR).alias("purity"))

    def down(state: Column, x: Column) -> Column:
        purity = (x["b"] + PRIOR_WEIGHT * state["prior"]) / (x["n"] + PRIOR_WEIGHT)
        return F.struct(F.when((x["b"] > 0) & (x["b"] < x["n"]), purity).otherwise(PRIOR).alias("prior"), purity.alias("purity"))

    pure = chain.select("host", "tree", "labels", F.aggregate("chain", start, down)["purity"].alias("purity"))
    return trees.select("host", "raw", "tree").join(pure, ["host", "tree"])


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every row."""
    parsed = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = parsed.withColumns({"rule": rule, "verdict": verdict, "raw": F.array_join(segments(F.col("path")), "/")})
    urls = stage(urls, "urls")
    judged = urls.join(template_tree(urls), ["host", "raw"], "left")
    own = F.when(F.col("purity") > REJECT_ABOVE, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), F.concat(F.lit("/"), F.array_join("tree", "/")).alias("template"), "purity")


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))

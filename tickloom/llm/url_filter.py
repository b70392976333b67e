"""URL filters: rules first, then a template tree of each host's paths, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stage

#: (host, path prefix, verdict)
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"),
         ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
MAX_CHILDREN = 32  # a node with more children is a variable
SIMILAR_Z = 1.96   # children whose share of bad pages is this near to their node's are one branch
SMOOTHING = 4.0    # labelled pages at the corpus rate that each template starts with
REJECT = 0.5       # smoothed share of bad pages from which a template is rejected
#: A page is evidence of a bad place if its host has one of these words between dots and hyphens, or if its text is this much bars.
BAD_WORDS, BARS = ("adult", "ads", "bets", "casino", "pills", "spam"), 0.25


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
                   F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
            for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def shape_of(path: Column) -> Column:
    """The path's segments, with # for digits."""
    return F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), "[0-9]+", "#"), "/")


def evidence(pages: DataFrame, bad_words=BAD_WORDS, bars: float = BARS) -> DataFrame:
    """page_id and bad (0 or 1) of pages with a url and html, from the page itself: its host's words, and the bars in
    its visible text for each blank. A page without url or html says nothing."""
    seen = pages.select("page_id", F.split(host_of(F.col("url")), "[.-]").alias("host"), F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    count = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c)))
    bad = F.arrays_overlap("host", F.array(*map(F.lit, bad_words))) | (count("|") >= F.lit(bars) * F.greatest(count(" "), F.lit(1)))
    return seen.select("page_id", bad.cast("int").alias("bad"))


def similar(bad: Column, lab: Column, node_bad: Column, node_lab: Column) -> Column:
    """Two-proportion test of a child against its node: without labels, nothing tells them apart."""
    p = node_bad / F.greatest(node_lab, F.lit(1.0))
    gap = bad / F.greatest(lab, F.lit(1.0)) - p
    return (lab == 0) | (gap * gap * lab <= F.lit(SIMILAR_Z * SIMILAR_Z) * p * (1.0 - p))


def common_start(a: str, b: str) -> Column:
    """Leading segments that two arrays share, and so all that are sorted between them."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    return F.coalesce(F.nullif(F.array_position(same, F.lit(False)).cast("int"), F.lit(0)) - 1, F.size(a))


def template_tree(shapes: DataFrame) -> DataFrame:
    """host, shape, template from host, shape, lab, bad (one row for each shape of a host).

    Level by level, a node with over MAX_CHILDREN children becomes a variable for those
    that do not differ from it in their share of bad pages; so do siblings that are alike
    in it, if there are at least two. Each level is a grouping and a join of the shapes,
    not of the pages. A shape that is alone at its node or child cannot be merged any more and
    ends there with all its segments; segments that all shapes below a child share are passed
    at once. So there are as many rounds as nodes with several children on one way, and one for
    what follows a variable, however long the paths are.
    """
    at, ended = shapes.withColumn("prefix", F.lit("")).withColumn("level", F.lit(0)), None
    path = lambda first, count: F.concat(F.lit("/"), F.array_join(F.slice("shape", first, count), "/"))
    while True:
        at = at.withColumn("seg", F.coalesce(F.get("shape", F.col("level")), F.lit("")))
        child = at.groupBy("host", "prefix", "seg").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n"),
                                                        F.min("shape").alias("least"), F.max("shape").alias("most"), F.min("level").alias("level"))
        node = child.groupBy("host", "prefix").agg(F.sum("lab").alias("nlab"), F.sum("bad").alias("nbad"),
                                                   F.count(F.lit(1)).alias("children"), F.sum("n").alias("shapes"))
        alike = similar(F.col("bad"), F.col("lab"), F.col("nbad"), F.col("nlab"))
        enough = (F.col("children") > MAX_CHILDREN) | ((F.col("children") > 1) & (F.col("lab") > 0))
        variable = alike & enough & (F.col("seg") != "")
        own = ~variable & (F.col("seg") != "*")  # a segment that is a star meets the variables
        merged = (child.join(node, ["host", "prefix"])
                  .select("host", "prefix", "seg", F.when(variable, F.lit("*")).otherwise(F.col("seg")).alias("to"),
                          ((F.col("shapes") == 1) | (own & (F.col("n") == 1))).alias("alone"),
                          F.when(own, F.greatest(common_start("least", "most") - F.col("level") - 1, F.lit(0))).otherwise(0).alias("more")))
        level, size = F.col("level"), F.size("shape")
        rest = F.when(size > level, F.concat(path(level + 1, size), F.lit("/"))).otherwise(F.lit("/"))
        passed = F.when(F.col("more") > 0, path(level + 2, F.col("more"))).otherwise(F.lit(""))
        moved = stage(at.join(merged, ["host", "prefix", "seg"]).select(
            "host", "shape", "lab", "bad", (level + 1 + F.col("more")).alias("level"), (F.col("alone") | (size <= level)).alias("ends"),
            F.concat("prefix", F.when(F.col("alone"), rest).otherwise(F.concat(F.lit("/"), F.col("to"), passed))).alias("prefix")))
        done = moved.filter("ends").select("host", "shape", "lab", "bad", F.col("prefix").alias("template"))
        ended = done if ended is None else ended.unionByName(done)
        at = moved.filter("NOT ends").drop("ends")
        if not at.head(1):
            return ended


def url_filter(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the template of each page.

    labels holds page_id and bad (0 or 1) of some pages. The longest rule that fits
    decides; else the template of the page: its labelled pages and SMOOTHING more at the
    rate of all labels must be bad to less than REJECT. So a template is rejected by its
    labelled pages, whether a page has a label itself or not.

    A url that is null or without :// has empty host and path. Labels with a null in
    either column and labels of unknown pages do not count; a page that repeats counts
    each time, as does a label that repeats. Empty tables give no rows, or only
    unlabelled templates, which are allowed. Further columns are ignored.
    """
    url = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    url = url.withColumn("shape", shape_of(F.col("path")))
    marks = (labels.select("page_id", F.col("bad").cast("double").alias("bad")).dropna()
             .groupBy("page_id").agg(F.count(F.lit(1)).cast("double").alias("lab"), F.sum("bad").alias("bad")))
    counted = (url.join(marks, "page_id", "left").groupBy("host", "shape")
               .agg(F.coalesce(F.sum("lab"), F.lit(0.0)).alias("lab"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad")))
    shapes = stage(counted)
    total = shapes.agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad")).first()
    rate = (total["bad"] or 0.0) / max(total["lab"] or 0.0, 1.0)
    tree = stage(template_tree(shapes))
    purity = tree.groupBy("host", "template").agg(
        ((F.sum("bad") + F.lit(SMOOTHING * rate)) / (F.sum("lab") + F.lit(SMOOTHING))).alias("purity"))
    judged = stage(tree.select("host", "shape", "template").join(purity, ["host", "template"]))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return (url.join(judged, ["host", "shape"]).withColumn("r", rule)
            .select("page_id", "host", "path", F.col("r.rule").alias("rule"),
                    F.coalesce(F.col("r.verdict"), method).alias("verdict"), "template"))

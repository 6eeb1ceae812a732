"""URL filters with a tree of path templates, in DataFrame operations alone.

Each host has a tree of path segments. Segments that vary (numbers, hexadecimal ids, segments too rare
under their parent) become wildcards. Below a node, branches whose labels can't be told from the node's
share of good pages are merged with their subtrees; the others stay apart. A branch's purity, its share of good pages, is
smoothed towards its parent's, once for the same labels: a branch with all labels of its node keeps the node's. Templates under the
least purity are blocked, and fixed rules overrule.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

LEAST_SUPPORT = 5
#: Labelled pages that the parent's purity counts as.
PRIOR = 8.0
#: Standard deviations within which branches are similar.
SIMILAR = 1.64
LEAST_PURITY = 0.5
#: The branch that similar branches become; no segment has a slash.
MERGED = "/*"
#: Rules that become conditions of the plan; longer lists are joined by host.
CHAIN = 200


@dataclass(frozen=True)
class Rule:
    """For a host and its subdomains and paths that start with path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; without `://` empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def document_of(path: Column) -> Column:
    """The number that the last segment is, without extension and trailing slashes, or null."""
    return F.regexp_extract(path, r"/([0-9]+)(?:[.][^/]*)?/*\z", 1).try_cast("long")


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as struct<name,verdict>, or null, as a chain of conditions."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def with_rules(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """pages (host, path, more) with fits, the longest fitting rule as struct<name,verdict>, or null.

    Of a long list each distinct host gets the rules of its own name and of those it is a subdomain of.
    """
    if len(rules) <= CHAIN:
        return pages.withColumn("fits", rule_of(F.col("host"), F.col("path"), rules))
    rows = [(r.host, len(r.name), r.name, r.path, r.verdict) for r in set(rules)]
    table = pages.sparkSession.createDataFrame(rows, "above string, size int, name string, start string, verdict string")
    labels = F.split("host", "[.]", -1)
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    own = pages.select("host").distinct().withColumn("above", above).join(table, "above")
    own = own.groupBy("host").agg(F.reverse(F.array_sort(F.collect_list(F.struct("size", "name", "start", "verdict")))).alias("rules"))
    first = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["start"])), F.lit(0))
    fits = F.when(first.isNotNull(), F.struct(first["name"].alias("name"), first["verdict"].alias("verdict")))
    return pages.join(own, "host", "left").withColumn("fits", fits).drop("rules")


def _segment(value: Column) -> Column:
    """A segment with numbers and hexadecimal ids as wildcards."""
    return F.when(value.rlike(r"\A[0-9a-f]{8,}\z"), F.lit("{h}")).otherwise(F.regexp_replace(value, "[0-9]+", "{n}"))


def _segments(path: Column) -> Column:
    """All generalised segments of the path."""
    parts = F.split(path, "/", -1)
    return F.transform(F.slice(parts, F.lit(2), F.size(parts)), _segment)


def branch_purity(parent: Column, good: Column, labelled: Column) -> Column:
    return (good + PRIOR * parent) / (labelled + PRIOR)


def _far(good: Column, labelled: Column, purity: Column) -> Column:
    return F.abs(good - labelled * purity) > SIMILAR * F.sqrt(labelled * purity * (1 - purity))


def _going_on() -> Column:
    """Whether branches of a node can matter: it has paths that differ, support, and labels that can be told apart.

    No part of the labels is farther from the node's purity than all its good or all its bad ones.
    """
    good, bad, none = F.col("good"), F.col("labelled") - F.col("good"), F.lit(0.0)
    apart = _far(good, good, F.col("purity")) | _far(none, bad, F.col("purity"))
    return (F.col("least") != F.col("most")) & (F.col("n") >= LEAST_SUPPORT) & apart


def _shared() -> Column:
    """The number of first segments that all paths of a node share: that of its least and its most."""
    same = F.zip_with("least", "most", lambda a, b: a.eqNullSafe(b))
    return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)), F.size(same) + F.lit(1)) - 1


def _settled(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes with on, whether the tree goes on below, and shared, the segments that all paths of the node begin with."""
    ends = tree.groupBy("node").agg(F.min("rest").alias("least"), F.max("rest").alias("most"))
    return nodes.join(ends, "node").withColumn("on", _going_on()).withColumn("shared", _shared().cast("int")).drop("least", "most")


def template_purity(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """host and segments (as in the rows) with the purity of the template that they fall under.

    pages: host, segments, good (1, 0 or null). One row a distinct generalised path.

    From the host down a node goes on while its branches can matter, at the first segment in which its paths differ, so that the steps are
    bounded by the data's branchings and labels, not by its longest path. A branch that has all labels of its node tells nothing new and keeps its purity.
    """
    keys = ["host", "segments"]
    sums = [F.sum(x).alias(x) for x in ("n", "good", "labelled")]
    paths = pages.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("good").cast("double").alias("good"), F.count("good").cast("double").alias("labelled"))
    paths = scratch.stored(paths.fillna(0.0, ["good"]), "paths")
    total = paths.agg(F.sum("good"), F.sum("labelled")).first()
    whole = (total[0] / total[1]) if total[1] else 1.0
    # similar branches of a node become one branch, whose subtrees meet on the next level
    tree = paths.withColumns({"node": F.array("host"), "rest": F.col("segments")})
    nodes = tree.groupBy("node").agg(*sums).withColumn("purity", branch_purity(F.lit(whole), F.col("good"), F.col("labelled")))
    nodes, done = scratch.stored(_settled(tree, nodes), "nodes"), []
    while True:
        done.append(tree.join(nodes.filter("not on").select("node", "purity"), "node").select(*keys, "purity"))
        nodes = nodes.filter("on").drop("on")
        if nodes.isEmpty():
            return reduce(DataFrame.union, done)
        # segments too rare under their node become wildcards
        cut = tree.join(nodes.select("node", "shared"), "node").withColumn("segment", F.coalesce(F.get("rest", F.col("shared")), F.lit("")))
        cut = cut.withColumn("rest", F.slice("rest", F.col("shared") + 2, F.size("rest") + 1)).drop("shared")
        support = cut.groupBy("node", "segment").agg(F.sum("n").alias("support")).filter(F.col("support") < LEAST_SUPPORT)
        rare = support.select("node", "segment", F.lit("*").alias("wild"))
        cut = scratch.stored(cut.join(rare, ["node", "segment"], "left").withColumn("segment", F.coalesce("wild", "segment")).drop("wild"), "cut")
        own = cut.groupBy("node", "segment").agg(*sums).join(nodes.select("node", "purity", F.col("labelled").alias("all")), "node")
        apart = _far(F.col("good"), F.col("labelled"), F.col("purity"))
        own = scratch.stored(own.withColumn("branch", F.when(apart, F.col("segment")).otherwise(MERGED)), "own")
        tree = cut.join(own.select("node", "segment", "branch"), ["node", "segment"])
        tree = scratch.stored(tree.withColumn("node", F.concat("node", F.array("branch"))).drop("segment", "branch"), "tree")
        pooled = own.groupBy("node", "branch").agg(*sums, F.first("purity").alias("p"), F.first("all").alias("all"))
        new = F.when(F.col("labelled") == F.col("all"), F.col("p")).otherwise(branch_purity(F.col("p"), F.col("good"), F.col("labelled")))
        nodes = pooled.select(F.concat("node", F.array("branch")).alias("node"), "n", "good", "labelled", new.alias("purity"))
        nodes = scratch.stored(_settled(tree, nodes), "nodes")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[Rule], least_purity: float = LEAST_PURITY, key: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict of each row of pages (page_id, url).

    labels (key, good 0/1, null: unlabelled) tell good pages; several labels of a key count as one, good if all
    are. The key is page_id, or doc_id: the number in the url's path, see document_of. A url that is null or has no `://` has an empty host and path and belongs to their template. The
    verdict is the longest fitting rule's, else block if the template's smoothed purity is under least_purity,
    else allow; without any labels all is allowed. Repeated rows count and give repeated results, an empty
    table gives an empty result; other columns are ignored. Rows are joined with blocked templates only.
    """
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    named = named.withColumns({"segments": _segments(F.col("path")), "doc_id": document_of(F.col("path"))})
    known = labels.filter("good is not null").groupBy(key).agg(F.min("good").alias("good"))
    # pages without a key are dealt out by their host and path, as nothing fits them
    spread = F.when(F.col(key).isNull(), F.xxhash64("host", "path")).otherwise(F.lit(0))
    labelled = named.withColumn("spread", spread).join(known.withColumn("spread", F.lit(0).cast("long")), [key, "spread"], "left")
    scratch, keys = Scratch(pages.sparkSession), ["host", "segments"]
    purity = template_purity(labelled.drop("spread"), scratch)
    blocked = scratch.stored(purity.filter(F.col("purity") < least_purity).select(*keys, F.lit("block").alias("found")), "blocked")
    scratch.clear(blocked)
    judged = with_rules(named.join(blocked, keys, "left"), rules)
    verdict = F.coalesce("fits.verdict", "found", F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("fits.name").alias("rule"), verdict.alias("verdict"))

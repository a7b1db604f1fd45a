"""URL verdicts: rules first, then a tree of path templates per host.

Paths are cut into segments. Segments that vary by their form (digits, hexadecimal codes,
dates) are placeholders from the start. Where a tree node branches, its rare children, if
there are many, become one wildcard, unless their statistics differ clearly from those of
their siblings: the share of blocked labels, of paths that end there, or of placeholders
next. A template is rejected if the smoothed share of blocked labels below it is high.
Labels are the verdicts of the rules.

A round works off one branching of every node and the unbranched chain before it, so
the number of rounds is that of branchings, not of segments. Counts are taken over
distinct (host, path) and summed before they are dealt out; what a hot node's rows are
joined with is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import join_hot, materialize

#: A parent with so many children has variable ones, if each is at most such a share of it.
MANY, RARE = 8, 0.2
#: A child whose statistics are so many standard errors from its siblings' keeps its own branch.
APART = 2.0
#: Labels that the prior of one half is worth, and the share at which a template is rejected.
PRIOR, REJECT = 2.0, 0.8


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(pages: DataFrame) -> DataFrame:
    """Add host (A-Z in lower case) and path of `url`; both empty without a "://"."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract("_rest", "^[^/?#]*", 0)
    path = F.regexp_extract(F.expr("substring(_rest, length(_raw) + 1)"), "^[^?#]*", 0)
    return pages.withColumn("_rest", rest).withColumn("_raw", host).withColumn("path", path).withColumn("host", _lower_ascii(F.col("_raw"))).drop("_rest", "_raw")


def rule_of(rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    out = F.lit(None)
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _typed(segment: Column) -> Column:
    """The placeholder of a segment that varies by its form, or null."""
    return F.when(segment.rlike("^[0-9]+$"), "{num}").when(segment.rlike("^[0-9]+\\.[A-Za-z]+$"), "{num}.ext").when(segment.rlike("^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), "{hex}").when(segment.rlike("^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "{date}")


def _shared(lo: Column, hi: Column) -> Column:
    """How many first elements two arrays share."""
    n = F.least(F.size(lo), F.size(hi))
    same = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(lo, i) == F.get(hi, i))
    first = F.array_position(same, False)
    return F.when(n == 0, 0).when(first == 0, n).otherwise(first - 1).cast("int")


def _below(head: Column, segments: Column) -> Column:
    return F.concat(head, F.array_join(F.transform(segments, lambda s: F.concat(F.lit("/"), s)), ""))


def _alike(count: str, among: str) -> Column:
    """Whether a child's share of `count` in `among` is near its siblings', by the standard error of their difference."""
    x, n, all_x, all_n = F.col(count), F.col(among), F.col(f"p_{count}"), F.col(f"p_{among}")
    pooled = (all_x + 0.5) / (all_n + 1)
    gap = F.abs(F.try_divide(x, n) - F.try_divide(all_x - x, all_n - n))
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n) + F.try_divide(F.lit(1.0), all_n - n)))
    return F.coalesce(gap <= APART * error, F.lit(True))


def templates(paths: DataFrame) -> DataFrame:
    """(host, path, n, template, score) from (host, path, blocked, allowed, n): one row per distinct host and path."""
    parts = F.split(F.regexp_replace("path", "^/", ""), "/")
    tree = materialize(paths.withColumn("_rest", F.transform(parts, lambda s: F.coalesce(_typed(s), s))).withColumn("template", F.lit("")), "template-tree")
    rest, done, total = F.col("_rest"), [], tree.count()
    node = ["host", "template"]
    while True:
        # The chain of segments that all paths of a node share.
        ends = tree.groupBy(*node).agg(F.min("_rest").alias("lo"), F.max("_rest").alias("hi"), F.count("*").alias("_w"))
        ends = materialize(ends.select(*node, _shared(F.col("lo"), F.col("hi")).alias("_k"), "_w"), "template-chains")
        tree = join_hot(tree, ends, node, "_w", total)
        tree = tree.withColumn("template", _below(F.col("template"), F.slice(rest, F.lit(1), F.col("_k")))).withColumn("_rest", F.slice(rest, F.col("_k") + 1, F.size(rest))).drop("_k")
        tree = materialize(tree, "template-tree")
        done.append(tree.where(F.size(rest) == 0).drop("_rest"))
        tree = tree.where(F.size(rest) > 0).withColumn("_seg", F.get(rest, F.lit(0)))
        if tree.isEmpty():
            break
        labelled = F.col("blocked") + F.col("allowed")
        ending, typed = F.when(F.size(rest) == 1, F.col("n")).otherwise(0), F.when(F.get(rest, F.lit(1)).startswith("{"), F.col("n")).otherwise(0)
        child = tree.groupBy(*node, "_seg").agg(F.count("*").alias("paths"), F.sum("n").alias("n"), F.sum("blocked").alias("blocked"), F.sum(labelled).alias("labelled"), F.sum(ending).alias("ending"), F.sum(typed).alias("typed"))
        child = materialize(child, "template-children")
        parent = child.groupBy(*node).agg(F.count("*").alias("kids"), *(F.sum(c).alias(f"p_{c}") for c in ("n", "blocked", "labelled", "ending", "typed"))).where(F.col("kids") >= MANY)
        parent = materialize(parent.withColumn("_w", F.col("kids")), "template-parents")
        both = join_hot(child, parent, node, "_w", total)
        alike = _alike("blocked", "labelled") & _alike("ending", "n") & _alike("typed", "n")
        merged = both.where((F.col("n") <= RARE * F.col("p_n")) & alike & ~F.col("_seg").startswith("{")).select(*node, "_seg", F.lit("*").alias("_node"))
        tree = tree.join(materialize(merged, "template-merged"), [*node, "_seg"], "left")
        tree = tree.withColumn("template", F.concat("template", F.lit("/"), F.coalesce("_node", "_seg"))).withColumn("_rest", F.slice(rest, F.lit(2), F.size(rest))).drop("_node", "_seg")
        tree = materialize(tree, "template-tree")
        # What ends with the branching itself is done as well.
        done.append(tree.where(F.size(rest) == 0).drop("_rest"))
        tree = tree.where(F.size(rest) > 0)
        if tree.isEmpty():
            break
    all_ = done[0]
    for more in done[1:]:
        all_ = all_.unionByName(more)
    score = (F.sum("blocked") + PRIOR / 2) / (F.sum("blocked") + F.sum("allowed") + PRIOR)
    purity = materialize(all_.groupBy(*node).agg(score.alias("score"), F.count("*").alias("_w")), "template-purity")
    return join_hot(all_.select("host", "path", "n", "template"), purity, node, "_w", total)


def url_verdicts(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, score) for every row of `pages` (page_id, url).

    The rule's verdict, else `block` if the page's template scores REJECT or more, else `allow`:
    a template without labels scores one half. Null urls and urls without "://" have empty parts
    and are judged like others; paths may be of any length. Rows that repeat count as often as
    they occur. Of rules that fit with one length the last named holds. Other columns are ignored.
    """
    judged = with_parts(pages.select("page_id", "url")).withColumn("_rule", rule_of(rules))
    judged = materialize(judged.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("by_rule")), "urls")
    paths = judged.groupBy("host", "path").agg(F.count("*").alias("n"), F.count_if(F.col("by_rule") == "block").alias("blocked"), F.count_if(F.col("by_rule") == "allow").alias("allowed"))
    found = join_hot(judged, materialize(templates(paths), "templates"), ["host", "path"], "n", judged.count())
    verdict = F.coalesce("by_rule", F.when(F.col("score") >= REJECT, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "score")

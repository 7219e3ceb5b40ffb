"""URL filters with redirect equivalence.

A url is judged by the longest rule that fits its host and path. Redirects and canonical links tie urls together:
connected components over these edges carry a block to every alias that no rule of its own names. An explicit allow
takes precedence: a url that an allow rule fits stays allowed whatever its aliases are.

Native: DataFrame functions only. Links are read from the page (``link rel=canonical`` and ``meta http-equiv=refresh``)
and, if given, from a table of observed redirects. Urls are nodes by host, path and query: scheme and fragment do not
tell pages apart.

Nulls and odd rows: a null url, or one without ``://``, has an empty host and path, fits no rule, has no aliases and
is allowed. A null html has no links. Repeated rows are judged each. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import Scratch, lower_ascii, whole
from tallyhouse.llm.components import connected_components


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"://([^/?#]*)([^?#]*)"
    return lower_ascii(F.regexp_extract(whole(url), pattern, 1)), F.regexp_extract(whole(url), pattern, 2)


def suffixes(host: Column) -> Column:
    """A host and its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def with_rule(df: DataFrame, rules: DataFrame) -> DataFrame:
    """df (host, path) with ``fit``: the longest rule that fits, allow before block among equals, or null.

    rules: host, path, verdict, any number of them. Hosts meet rules by their suffixes, each place once; Spark
    broadcasts the rules while they are small. Of the rules that meet a place the best is kept before the shuffle.
    """
    places = df.select("host", "path").distinct()
    named = rules.select(F.col("host").alias("_suffix"), F.col("path").alias("_start"), F.col("verdict").alias("_verdict"))
    met = places.withColumn("_suffix", F.explode(suffixes(F.col("host")))).join(named, "_suffix").where(F.col("path").startswith(F.col("_start")))
    name = F.concat("_suffix", "_start")
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length(name).alias("n"), (F.col("_verdict") == "allow").alias("allow"), name.alias("rule"))).alias("b"))
    fit = F.struct(F.col("b.rule").alias("rule"), F.when(F.col("b.allow"), "allow").otherwise("block").alias("verdict"))
    found = best.select(F.col("host").alias("_h"), F.col("path").alias("_p"), fit.alias("fit"))
    return df.join(found, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left").drop("_h", "_p")


def node(url: Column) -> Column:
    """host, path and query of an absolute url; null without ``://``."""
    host, path = host_and_path(url)
    query = F.regexp_extract(whole(url), r"^[^#?]*(\?[^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host, F.when(path == "", "/").otherwise(path), query))


def absolute(link: Column, url: Column) -> Column:
    """link as it reads on the page at url."""
    scheme = F.regexp_extract(url, r"^([^:/?#]*)://", 1)
    host, path = host_and_path(url)
    site = F.concat(scheme, F.lit("://"), host)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(site, path, link))
        .when((link == "") | link.startswith("#") | link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .otherwise(F.concat(site, F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", ""), link))
    )


def page_links(html: Column) -> Column:
    """Targets of canonical links and refreshes, as written in the page."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<(?:link|meta)\b[^>]*+>"), F.lit(0)), lambda t: t.rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b|\bhttp-equiv\s*=\s*[\"']?refresh\b"))
    target = r"(?i)(?:\bhref\s*=\s*|;\s*url\s*=\s*)[\"']?([^\"'>\s]+)"
    found = F.filter(F.transform(tags, lambda t: F.replace(F.regexp_extract(t, target, 1), F.lit("&amp;"), F.lit("&"))), lambda x: x != "")
    return F.when(html.rlike(r"(?i)canonical|refresh"), found)


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, scratch: Scratch, redirects: DataFrame | None = None) -> DataFrame:
    """pages (page_id, url, html) -> page_id, host, path, rule, verdict. redirects: observed (src, dst) urls.

    rules: a list, or a table of host, path and verdict with any number of rows.
    """
    if not isinstance(rules, DataFrame):
        rules = pages.sparkSession.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")
    host, path = host_and_path(F.col("url"))
    own = scratch.keep(pages.select("page_id", host.alias("host"), path.alias("path"), node(F.col("url")).alias("node"), F.transform(page_links(F.col("html")), lambda t: node(absolute(t, F.col("url")))).alias("links")))
    edges = own.where("links is not null").select(F.col("node").alias("a"), F.explode("links").alias("b"))
    if redirects is not None:
        edges = edges.union(redirects.select(node(F.col("src")), node(F.col("dst"))))
    comp = scratch.keep(connected_components(edges.where("a is not null and b is not null"), scratch))
    judged = with_rule(own, rules)
    if comp.isEmpty():
        judged = judged.withColumn("blocked", F.lit(False))
    else:
        h, p = F.regexp_extract("node", "^([^/?]*)", 1), F.regexp_extract("node", r"^[^/?]*([^?]*)", 1)
        members = with_rule(comp.select("node", "component", h.alias("host"), p.alias("path")), rules)
        bad = members.where("fit.verdict = 'block'").select("component").distinct()
        aliases = comp.join(bad, "component").select(F.col("node").alias("_node"), F.lit(True).alias("blocked"))
        judged = judged.where("node is not null").join(aliases, F.col("node") == F.col("_node"), "left").drop("_node").unionByName(judged.where("node is null").withColumn("blocked", F.lit(None).cast("boolean")))
    by_alias = F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), by_alias).alias("verdict"))

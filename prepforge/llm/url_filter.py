"""URL rules, carried over to aliases by redirect and canonical-link edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepforge.llm.components import components
from prepforge.llm.tables import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINK = r"(?is)<link\b[^>]*>"
META = r"(?is)<meta\b[^>]*>"
CANONICAL = r"(?is)\brel\s*=\s*[\"']?\s*canonical\b"
REFRESH = r"(?is)\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"
HREF = r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"
GOAL = r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>;]+)"


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def url_host(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_node(url: Column) -> Column:
    """What two URLs must share to be the same page: host, path and query, not scheme or fragment."""
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*(\?[^#]*)?", 1)
    return F.when(F.locate("://", url) > 0, F.concat(url_host(url), url_path(url), query))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as a struct ``size, rule, verdict``, or null.

    ``rules`` are (host, path, verdict), held by the driver: they become a
    constant of the plan, so they are meant to be a policy, not a crawl.
    """
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    by_host: dict[str, list[tuple[str, str]]] = {}
    for rule_host, rule_path, verdict in rules:
        by_host.setdefault(rule_host.lower(), []).append((rule_path, verdict))
    known = F.create_map(*[x for h, own in sorted(by_host.items()) for x in (F.lit(h), F.array(*[
        F.struct(F.lit(p).alias("path"), F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"),
                 F.lit(v).alias("verdict")) for p, v in sorted(own)]))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(
        F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(known, s), F.array()))),
        lambda r: path.startswith(r["path"]))
    return F.array_max(F.transform(fitting, lambda r: F.struct(r["size"], r["rule"], r["verdict"])))


def html_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``a, b``: from every page to its canonical link and to the goal of its refresh.

    Goals are absolute, ``//host/...`` or ``/...``; others and pages without
    ``://`` in their URL give no edge.
    """
    url, html = F.col(f"`{url_col}`"), F.col(f"`{html_col}`")

    def goal(tags: str, kind: str, value: str) -> Column:
        found = F.filter(F.regexp_extract_all(html, F.lit(tags), F.lit(0)), lambda t: t.rlike(kind))
        return F.regexp_extract(F.get(found, F.lit(0)), value, 1)

    goals = pages.select(url.alias("url"), F.explode(F.array(
        goal(LINK, CANONICAL, HREF), goal(META, REFRESH, GOAL))).alias("goal"))
    start = F.concat(F.substring_index("url", "://", 1), F.lit("://"))
    target = (F.when(F.col("goal").contains("://"), F.col("goal"))
              .when(F.col("goal").startswith("//"), F.concat(start, F.substring("goal", 3, 1 << 30)))
              .when(F.col("goal").startswith("/"), F.concat(start, url_host(F.col("url")), F.col("goal"))))
    return (goals.where("goal <> ''").select(url_node(F.col("url")).alias("a"), url_node(target).alias("b"))
            .where("a IS NOT NULL AND b IS NOT NULL AND a <> b"))


def filter_urls(pages: DataFrame, edges: DataFrame, rules: Sequence[tuple[str, str, str]],
                default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, aliases``: one row per row of ``pages``.

    A URL's own longest rule decides. A URL without a rule takes the decision of
    its aliases, the component it belongs to under ``edges`` (``a, b`` as by
    ``url_node``): allow if a rule allows any alias, else block if a rule blocks
    any, else ``default``. Aliases need not be pages themselves. ``aliases`` is
    the number of URLs in the component, 1 without edges.

    A null URL or one without ``://`` has empty host and path, no rule and no
    alias. Rows that repeat a URL share its verdict. Null ends of edges and
    edges to the page itself are ignored. No rows give no rows.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    url = F.col(f"`{url_col}`")
    parsed = pages.select(F.col(f"`{id_col}`").alias("page_id"), url_host(url).alias("host"),
                          url_path(url).alias("path"), url_node(url).alias("node"))
    judged = parsed.withColumn("own", F.when(F.col("node").isNotNull(), rule_for(F.col("host"), F.col("path"), rules)))
    joined = scratch.write(components(edges))
    full = F.concat(F.lit("://"), F.col("node"))
    named = joined.withColumn("own", rule_for(url_host(full), url_path(full), rules))
    decided = named.groupBy("label").agg(
        F.count("*").alias("aliases"),
        F.max(F.coalesce(F.col("own.verdict") == "allow", F.lit(False))).alias("allowed"),
        F.max(F.coalesce(F.col("own.verdict") == "block", F.lit(False))).alias("blocked"))
    inherited = (joined.join(decided, "label").select(
        "node", "aliases", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("inherited")))
    verdict = F.coalesce(F.col("own.verdict"), F.col("inherited"), F.lit(default))
    return judged.join(inherited, "node", "left").select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"),
        F.coalesce("aliases", F.lit(1)).cast("long").alias("aliases"))

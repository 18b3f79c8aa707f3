"""URL filter by rules and redirect equivalence.

A rule names a host and a path prefix; it fits the host, its subdomains and
every path that starts with the prefix, and of the rules that fit the longest
wins.  Redirects (``<meta http-equiv=refresh>``) and canonical links
(``<link rel=canonical>``) make two addresses aliases.  Aliases form connected
components, and a block of any member is a block of every member that no rule
names; an address that a rule allows stays allowed whatever its aliases are.
Everything else is allowed.

An address is host + path + query: scheme and fragment play no part.  A NULL
url, or one without ``://``, has empty host and path, fits no rule and is no
alias of anything (allow).  NULL or empty html has no links.  Link targets are
whole attribute values (up to their own closing quote) with the usual entities
decoded; relative ones are taken against the page's host and folder.  Dot
segments are resolved before addresses are compared.  ``canonical`` may be any
token of ``rel``.  Repeated pages each get a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.llm.common import cut
from driftmark.llm.components import components

ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TAGS = r"""(?is)<(?:link|meta)\b(?:[^>"']|"[^"]*"|'[^']*')*>"""
VALUE = r"""(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
REFRESH = r"""(?is)\burl\s*=\s*(?:"([^"]*)|'([^']*)|([^"'].*))"""
#: Entities in addresses, the ampersand last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&#38;", "&"), ("&amp;", "&")]


def _first(c: Column, pattern: str) -> Column:
    """The one of three groups that is there, or an empty text."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, pattern, i), F.lit("")) for i in (1, 2, 3)], F.lit(""))


def attribute(tag: Column, name: str) -> Column:
    return _first(tag, rf"""(?is)[\s"'/]{name}\s*=\s*{VALUE}""")


def link_target(tag: Column) -> Column:
    """Where a canonical link or a refresh goes; empty for any other tag."""
    kind = lower_ascii(F.substring(tag, 2, 4))
    canonical = (kind == "link") & F.regexp_like(attribute(tag, "rel"), F.lit(r"(?i)(^|\s)canonical(\s|$)"))
    refresh = (kind == "meta") & (lower_ascii(F.trim(attribute(tag, "http-equiv"))) == "refresh")
    to = F.when(canonical, attribute(tag, "href")).when(refresh, _first(attribute(tag, "content"), REFRESH)).otherwise("")
    for entity, char in ENTITIES:
        to = F.replace(to, F.lit(entity), F.lit(char))
    return F.trim(to)


def resolved(path: Column) -> Column:
    """A path without dot segments."""
    parts = F.split(path, "/")
    step = lambda acc, x: (F.when(x == "..", F.regexp_replace(acc, r"/[^/]*$", "")).when(x == ".", acc)
                           .otherwise(F.concat(acc, F.lit("/"), x)))
    folded = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.lit(""), step)
    return F.concat(folded, F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, ABC, ABC.lower())


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query (with its ``?``) of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return (lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)),
            F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1),
            F.regexp_extract(rest, r"(?s)^[^?#]*(\?[^#]*)?", 1))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The rule string and verdict that fit, NULL if none does.  ``rules``
    are (verdict, host, path) and become one CASE, longest first."""
    rule = verdict = F
    for act, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = rule.when(fits, F.lit(h + p)), verdict.when(fits, F.lit(act))
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def alias_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(host, path, query, to_host, to_path, to_query)`` of every redirect
    and canonical link of a page."""
    host, path, query = split_url(F.col("url"))
    found = (pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))
             .where(F.instr("url", "://") > 0)
             .select(host.alias("host"), path.alias("path"), query.alias("query"),
                     F.explode(F.regexp_extract_all("html", F.lit(TAGS), F.lit(0))).alias("tag"))
             .select("host", "path", "query", link_target(F.col("tag")).alias("href")).where("href <> ''"))
    h = F.col("href")
    full = (F.when(h.contains("://"), h)
            .when(h.startswith("//"), F.concat(F.lit("x:"), h))
            .when(h.startswith("/"), F.concat(F.lit("x://"), "host", h))
            .when(h.startswith("?"), F.concat(F.lit("x://"), "host", "path", h))
            .when(h.startswith("#"), F.concat(F.lit("x://"), "host", "path", "query"))
            .otherwise(F.concat(F.lit("x://"), "host",
                                F.regexp_replace(F.regexp_replace("path", r"[^/]*$", ""), r"^$", "/"), h)))
    to = split_url(F.col("full"))
    return (found.withColumn("full", full)
            .select("host", "path", "query", to[0].alias("to_host"), resolved(to[1]).alias("to_path"),
                    to[2].alias("to_query")))


def _node(host: str, path: str, query: str) -> Column:
    return F.concat(host, resolved(F.col(path)), query)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id",
          url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of every page."""
    links = cut(alias_links(pages, url_col, html_col), "links").where("to_host <> ''")
    ends = links.select("host", "path", "query").union(links.select("to_host", "to_path", "to_query"))
    _, said = rule_for(F.col("host"), F.col("path"), rules)
    blocked = (ends.select(_node("host", "path", "query").alias("node"), said.alias("said"))
               .where("said = 'block'").select("node").distinct())
    groups = components(links.select(_node("host", "path", "query").alias("a"),
                                     _node("to_host", "to_path", "to_query").alias("b")), "a", "b")
    bad = groups.join(blocked, "node").select("component").distinct()
    # only addresses that share a component with a blocked one travel
    tainted = groups.join(bad, "component").select("node").distinct().withColumn("tainted", F.lit(True))
    host, path, query = split_url(F.col("url"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = (pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
            .select("page_id", host.alias("host"), path.alias("path"), query.alias("query"))
            .withColumn("node", _node("host", "path", "query")))
    return (rows.join(tainted, "node", "left")
            .select("page_id", "host", "path", rule.alias("rule"),
                    F.coalesce(verdict, F.when(F.col("tainted"), "block"), F.lit("allow")).alias("verdict")))

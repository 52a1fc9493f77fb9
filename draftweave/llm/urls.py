"""URL filters that follow redirects and canonical links.

Rules decide about hosts and paths. Pages also name each other: by canonical
links, by refresh redirects, and a URL with tracking parameters, a fragment or
a mirror host stands for its plain form. Connected components over these edges
are aliases of one another; a decision about one of them holds for all that no
rule decides, and an explicit allow goes before a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftweave.llm.components import connected_components
from draftweave.llm.naming import _LOWER, _UPPER
from draftweave.llm.storage import stored

#: Query parameters that don't choose a page, and host labels of mirrors.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)"
MIRRORS = r"^(?:www|m|amp)\.(?=[^.]+\.)"

_QUOTED = r"""(?:"([^"]*)"|'([^']*)'|([^\x09-\x0d\x20"'>]+))"""


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #``, A-Z lowered; empty for null or without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _query_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)


def _node(host: Column, path: Column, query: Column) -> Column:
    """A URL as a node: scheme and fragment make no difference. Null where there is no host."""
    return F.when(host != "", F.struct(host.alias("host"), path.alias("path"), query.alias("query")))


def _plain(node: Column) -> Column:
    """The node's canonical form: no mirror label, tracking parameter, file ending or closing slash."""
    query = F.regexp_replace(F.regexp_replace(node["query"], rf"(?i)(?<=[?&]){TRACKING}=[^&]*(?:&|$)", ""), r"[?&]+$", "")
    path = F.regexp_replace(F.regexp_replace(node["path"], r"(?i)(?:/index)?\.html?$", ""), r"/+$", "")
    return F.struct(F.regexp_replace(node["host"], MIRRORS, "").alias("host"), path.alias("path"), query.alias("query"))


def _targets(html: Column) -> Column:
    """URLs named by canonical links and refresh redirects of a page, as they are written."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    named = F.filter(tags, lambda t: t.rlike(r"""(?is)^<link\b.*\brel\s*=\s*["']?canonical\b|^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b"""))

    def url(tag: Column) -> Column:
        href = rf"(?is)\bhref\s*=\s*{_QUOTED}"
        link = F.concat(*[F.regexp_extract(tag, href, i) for i in (1, 2, 3)])
        moved = F.regexp_extract(tag, r"""(?is)\burl\s*=\s*['"]?([^"'>]*)""", 1)
        return F.trim(F.replace(F.when(tag.rlike(r"(?is)^<link\b"), link).otherwise(moved), F.lit("&amp;"), F.lit("&")))

    given = F.when(html.rlike(r"(?i)canonical|http-equiv"), F.filter(F.transform(named, url), lambda u: u != ""))
    return F.coalesce(given, F.array().cast("array<string>"))


def _absolute(target: Column, host: Column, path: Column) -> Column:
    folder = F.regexp_replace(path, r"[^/]*$", "")
    return (
        F.when(target.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("x:"), target))
        .when(target.startswith("/"), F.concat(F.lit("x://"), host, target))
        .when(target.startswith("?") | target.startswith("#"), F.concat(F.lit("x://"), host, path, target))
        .otherwise(F.concat(F.lit("x://"), host, F.when(folder == "", "/").otherwise(folder), target))
    )


def ruled(places: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, action`` of each distinct ``(host, path)`` that a rule fits; the longest wins.

    ``rules`` has ``host, path, action``. Every host meets the rules of itself
    and its parent domains by equality, so long rule lists are joined and not
    tried one by one. Of equally long rules an allow wins.
    """
    labels = F.split("host", r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = places.select("host", "path").distinct().withColumn("parent", F.explode(parents))
    wanted = rules.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "action")
    best = F.max(F.struct(
        (F.length("_host") + F.length("_path")).alias("n"), (F.col("action") == "allow").alias("allow"),
        F.concat("_host", "_path").alias("rule"), F.col("action").alias("action"),
    )).alias("best")
    return (
        each.join(wanted, F.col("parent") == F.col("_host")).filter(F.startswith("path", "_path"))
        .groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.action")
    )


def judged(
    pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
) -> DataFrame:
    """Verdict on every page: ``page_id, host, path, rule, verdict``.

    The verdict is that of the longest rule that fits. Else it is ``allow`` if
    an alias is explicitly allowed, ``block`` if one is blocked, ``allow``
    otherwise. A null URL, or one without ``://``, has an empty host and path,
    no alias and, unless a rule fits, the verdict ``allow``. Null html names
    nothing. Repeated rows and ids give a row each; an empty table gives none.
    Other columns are not looked at. A URL or page of any length is read whole.
    """
    own = F.col(url)
    base = pages.select(
        F.col(page_id).alias("page_id"), host_of(own).alias("host"), path_of(own).alias("path"), _query_of(own).alias("query"),
        _targets(F.col(html)).alias("targets"),
    )
    base = stored(base)
    here = _node(F.col("host"), F.col("path"), F.col("query"))
    named = F.transform("targets", lambda t: _absolute(t, F.col("host"), F.col("path")))
    to = F.transform(named, lambda u: F.struct(host_of(u).alias("host"), path_of(u).alias("path"), _query_of(u).alias("query")))
    links = (
        base.filter("host <> ''").select(here.alias("a"), F.explode(F.filter(to, lambda x: x["host"] != "")).alias("b"))
    )
    # Rules look at what stands at a path, so a plain form counts only as a name that aliases share.
    plain = lambda c: F.concat(F.lit("plain:"), F.to_json(_plain(F.col(c))))
    name = lambda c: F.concat(F.lit("url:"), F.to_json(F.col(c)))
    nodes = base.filter("host <> ''").select(here.alias("a")).unionByName(links.select(F.col("b").alias("a"))).distinct()
    nodes = stored(nodes.select(name("a").alias("node"), plain("a").alias("plain"), F.col("a.host").alias("host"), F.col("a.path").alias("path")))
    edges = nodes.select(F.col("node").alias("a"), F.col("plain").alias("b")).unionByName(links.select(name("a").alias("a"), name("b").alias("b")))
    aliases = connected_components(edges)
    found = stored(ruled(nodes.select("host", "path").unionByName(base.select("host", "path")), rules))
    decided = aliases.join(nodes.select("node", "host", "path"), "node").join(found, ["host", "path"])
    whole = stored(decided.groupBy("component").agg(F.max(F.col("action") == "allow").alias("allowed")))
    told = stored(aliases.join(whole, "component").filter(F.startswith("node", F.lit("url:"))).select("node", "allowed"))
    key = F.when(F.col("host") != "", F.concat(F.lit("url:"), F.to_json(F.struct("host", "path", "query"))))
    out = base.select("page_id", "host", "path", key.alias("node")).join(found, ["host", "path"], "left").join(told, "node", "left")
    verdict = F.coalesce(F.col("action"), F.when(F.col("allowed"), "allow").when(~F.col("allowed"), "block"), F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))

"""URL rules, and block decisions that spread over redirects and canonical links.

Rules are matched by a join on the host's suffixes. URLs that name each other by a
redirect or a canonical link form components, found by iterated minimum labels; a URL
without a rule of its own is blocked if a URL of its component is blocked by a rule and
none is allowed by one: an explicit allow takes precedence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.shared import written

#: (host, path prefix, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first ``://`` up to ``/ ? #``, lower-cased, and the
    rest up to ``? #``. Both are empty for null and for a URL without ``://``."""
    rest = _after(url)
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def _after(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_match(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. A rule fits its host
    and all subdomains. Longest is by the length of host and path; the rule list is small
    and becomes one expression."""
    longest_first = sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), -len(r[0])))
    table = F.array(
        *[
            F.struct(*[F.lit(v).alias(k) for k, v in zip(("host", "path", "verdict"), r, strict=True)])
            for r in longest_first
        ]
    )

    def best(url: Column) -> Column:
        fits = F.filter(
            table,
            lambda r: ((url["h"] == r["host"]) | F.endswith(url["h"], F.concat(F.lit("."), r["host"])))
            & F.startswith(url["p"], r["path"]),
        )
        return F.transform(
            F.slice(fits, 1, 1),
            lambda r: F.struct(F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict")),
        )

    bound = F.array(F.struct(host.alias("h"), path.alias("p")))
    return F.get(F.flatten(F.transform(bound, best)), F.lit(0))


def normal_url(url: Column) -> Column:
    """What identifies a node: no fragment, scheme and host lower-cased."""
    bare = F.regexp_extract(url, r"(?s)^([^#]*)", 1)
    head = F.regexp_extract(bare, r"(?s)^([^:/?#]*://[^/?#]*)", 1)
    return F.concat(ascii_lower(head), F.substring(bare, F.length(head) + 1, F.length(bare)))


def _resolved(target: Column, page: Column) -> Column:
    """An absolute URL for a link target found on a page; relative paths without a leading
    slash are taken from the page's folder."""
    t = F.trim(F.regexp_replace(target, "&amp;", "&"))
    scheme = F.regexp_extract(page, r"^([^:/?#]*):", 1)
    origin = F.regexp_extract(page, r"(?s)^([^:/?#]*://[^/?#]*)", 1)
    folder = F.regexp_extract(page, r"(?s)^([^:/?#]*://[^/?#]*[^?#]*/)", 1)
    return (
        F.when(t.contains("://"), t)
        .when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
        .when(t.startswith("/"), F.concat(origin, t))
        .otherwise(F.concat(F.when(folder == "", F.concat(origin, F.lit("/"))).otherwise(folder), t))
    )


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of one tag, quoted in either way or bare."""
    found = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1)
    return F.regexp_replace(found, r"^[\"']|[\"']$", "")


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): pages and the URLs that their canonical link or refresh redirect names."""
    html = F.col(html_col).cast("string")
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<link\s[^>]*>|<meta\s[^>]*>)"), 1)
    marked = html.rlike(r"(?i)canonical|http-equiv")  # most pages end here
    def target(tag: Column) -> Column:
        canonical = F.lower(_attribute(tag, "rel")).rlike(r"(^|\s)canonical(\s|$)")
        refresh = F.lower(_attribute(tag, "http-equiv")) == "refresh"
        to = F.regexp_extract(_attribute(tag, "content"), r"(?is)url\s*=\s*['\"]?([^'\"]*)", 1)
        return F.when(canonical, _attribute(tag, "href")).when(refresh, to)

    named = F.filter(F.transform(tags, target), lambda t: F.length(t) > 0)
    found = pages.where(marked & F.col(url_col).isNotNull()).select(
        F.col(url_col).cast("string").alias("_u"), named.alias("_ts")
    )
    # Lambdas keep these long expressions out of one generated method.
    ends = F.transform(
        F.col("_ts"),
        lambda t: F.struct(
            normal_url(F.col("_u")).alias("a"), normal_url(_resolved(t, F.col("_u"))).alias("b")
        ),
    )
    return found.select(F.inline(ends)).where("a <> b")


def url_verdicts(
    pages: DataFrame,
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    rules=RULES,
) -> DataFrame:
    """(id, host, path, rule, verdict), one row per input row.

    ``redirects`` may add edges (a, b) of URLs, as a crawler logs them. A URL that only an
    edge names takes part with the rule that fits it. In a component with both kinds of
    rules allow wins for the URLs without one. Null URLs and URLs without ``://`` have an
    empty host and path, fit no rule, take no part in components and are allowed. Rows
    that repeat an id or a URL each get their row. An empty table gives an empty result.
    """
    url = F.col(url_col).cast("string")
    edges = link_edges(pages, url_col, html_col)
    if redirects is not None:
        more = redirects.select(normal_url(F.col("a")).alias("a"), normal_url(F.col("b")).alias("b"))
        edges = edges.unionByName(more.where("a <> b"))
    edges = written(edges.distinct(), "url-edges")
    host, path = url_parts(url)
    judged = pages.select(
        F.col(id_col).alias("page_id"),
        host.alias("host"),
        path.alias("path"),
        rule_match(host, path, rules).alias("_m"),
        normal_url(url).alias("_u"),
    )
    out = lambda d, spread: d.select(
        "page_id", "host", "path", F.col("_m.rule").alias("rule"),
        F.coalesce(F.col("_m.verdict"), spread, F.lit("allow")).alias("verdict"),
    )
    if edges.isEmpty():
        return out(judged, F.lit(None).cast("string"))
    member = components(edges)
    h, p = url_parts(F.col("node"))
    verdict = rule_match(h, p, rules)["verdict"]
    spread = (
        member.select("component", verdict.alias("v"))
        .groupBy("component")
        .agg(F.max((F.col("v") == "block").cast("int")).alias("b"), F.max((F.col("v") == "allow").cast("int")).alias("a"))
        .where("b = 1 AND coalesce(a, 0) = 0")
        .select("component")
    )
    blocked = written(member.join(spread, "component", "left_semi").select("node"), "url-blocked")
    hit = judged.join(blocked.withColumn("_hit", F.lit("block")), judged["_u"] == blocked["node"], "left")
    return out(hit, F.col("_hit"))

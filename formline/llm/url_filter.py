"""URL filters by redirect equivalence, in DataFrame functions only.

Rules (host, path, verdict) fit their host and all its subdomains where the url's path starts with the rule's; of several the
longest (host and path together) counts. A url's own rule decides it. Urls without one are decided by their aliases: redirects and canonical
links are edges between urls, and connected components over these edges are classes of aliases. A class with an explicitly allowed url
is allowed, else a class with a blocked url is blocked, else its urls are allowed; so an explicit allow stands before every block that
comes by way of an alias, whether it is the url's own or an alias's.

Edges come from the pages (the first ``<link rel="canonical">`` and the first ``<meta http-equiv="refresh">`` outside comments, scripts and
styles, resolved against the page's url) and from a table of redirects (source, target) where there is one. Urls are compared without
their fragment, with scheme and host in lower case and dot segments folded. Targets take part in a class even where no page has their url.

Hot urls: edges are distinct pairs before anything meets, components contract stars in one round, decisions are two flags a class that
are aggregated before they travel, and only urls without a rule meet their class. Rules are a list bounded by the call.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule, has no alias and is allowed; a null or empty html has no
links; targets that are empty, a mere fragment or of a scheme without ``//`` (mailto, javascript) are no edges; repeated rows are judged alike; an empty
table gives no rows.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.llm.common import query, table
from formline.llm.components import components
from formline.session import stored

# The rules of the registered query.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

URL = r"(?s)^(.*?)://([^/?#]*)([^?#]*)([^#]*)"
UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
LINK, META = r"(?is)<link\b[^>]*>", r"(?is)<meta\b[^>]*>"
IS_CANONICAL = r"""(?is)\srel\s*=\s*["']?([^"'>]*\s)?canonical\b"""
IS_REFRESH = r"""(?is)\shttp-equiv\s*=\s*["']?\s*refresh\b"""
HREF = r"""(?is)\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
CONTENT = r"""(?is)\scontent\s*=\s*("[^"]*"|'[^']*')"""
TO = r"""(?is)^["'][\s\d.]*[;,]\s*url\s*=\s*(.*)["']$"""
OTHER_SCHEME = r"(?i)^[a-z][a-z0-9+.-]*:($|[^/]|/[^/]|/$)"
DOTS = r"/\.\.?(/|$)"


def lowered(text: Column) -> Column:
    """A to Z in lower case, all other characters as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return lowered(F.regexp_extract(url, URL, 2)), F.regexp_extract(url, URL, 3)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):  # the last one wins
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def folded(path: Column) -> Column:
    """A path with its dot segments resolved; an empty path is ``/``."""
    parts = F.split(path, "/")

    def onward(done: Column, part: Column) -> Column:
        return F.when(part == "..", F.regexp_replace(done, r"/[^/]*$", "")).when(part == ".", done).otherwise(F.concat(done, F.lit("/"), part))

    walked = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.lit(""), onward)
    walked = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(walked, F.lit("/"))).otherwise(walked)
    return F.when(path == "", F.lit("/")).when(path.rlike(DOTS), walked).otherwise(path)


def alias_key(url: Column) -> Column:
    """The spelling under which urls are compared; null where there is no ``://``."""
    piece = lambda k: F.regexp_extract(url, URL, k)
    key = F.concat(lowered(piece(1)), F.lit("://"), lowered(piece(2)), folded(piece(3)), piece(4))
    return F.when(F.contains(url, F.lit("://")), key)


def resolved(base: Column, target: Column) -> Column:
    """``target`` as a link on the page ``base``; null where it leads to no other page."""
    piece = lambda k: F.regexp_extract(base, URL, k)
    site = F.concat(piece(1), F.lit("://"), piece(2))
    folder = F.when(piece(3) == "", F.lit("/")).otherwise(F.regexp_replace(piece(3), r"[^/]*$", ""))
    return (F.when((target == "") | F.startswith(target, F.lit("#")) | target.rlike(OTHER_SCHEME), None)
            .when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), target)
            .when(F.startswith(target, F.lit("//")), F.concat(piece(1), F.lit(":"), target))
            .when(F.startswith(target, F.lit("/")), F.concat(site, target))
            .when(F.startswith(target, F.lit("?")), F.concat(site, piece(3), target))
            .otherwise(F.concat(site, folder, target)))


def first_tag(html: Column, tags: str, wanted: str) -> Column:
    return F.get(F.filter(F.regexp_extract_all(html, F.lit(tags), F.lit(0)), lambda t: t.rlike(wanted)), F.lit(0))


def plain(value: Column) -> Column:
    """An attribute's or refresh target's value without quotes, outer blanks and escaped ampersands."""
    return F.replace(F.regexp_replace(value, r"""^["'\s]+|["'\s]+$""", ""), F.lit("&amp;"), F.lit("&"))


def page_links(pages: DataFrame) -> DataFrame:
    """source, target (urls) of the canonical links and refreshes in ``pages`` (url, html)."""
    told = pages.filter(F.contains("url", F.lit("://")) & F.lower("html").rlike("canonical|refresh"))
    seen = told.select("url", F.regexp_replace("html", UNSEEN, "").alias("html"))
    href = plain(F.regexp_extract(first_tag(F.col("html"), LINK, IS_CANONICAL), HREF, 1))
    to = plain(F.regexp_extract(F.regexp_extract(first_tag(F.col("html"), META, IS_REFRESH), CONTENT, 1), TO, 1))
    both = seen.select("url", F.explode(F.array(href, to)).alias("to")).filter(F.col("to").isNotNull())
    return both.select(F.col("url").alias("source"), resolved(F.col("url"), F.col("to")).alias("target")).filter(F.col("target").isNotNull())


def alias_verdicts(links: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """key, verdict of the urls in ``links`` (source, target) whose class has a decided member."""
    ends = links.select(alias_key(F.col("source")).alias("u"), alias_key(F.col("target")).alias("v"))
    edges = stored(ends.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "url-edges")
    keys = edges.select(F.explode(F.array("u", "v")).alias("key")).distinct()
    nodes = stored(keys.select("key", F.monotonically_increasing_id().alias("node")), "url-nodes")
    a, b = nodes.toDF("u", "a"), nodes.toDF("v", "b")
    classes = nodes.join(components(edges.join(a, "u").join(b, "v").select("a", "b")), "node")
    classes = stored(classes.select("key", "component_id", rule_of(*host_and_path(F.col("key")), rules)["verdict"].alias("own")), "url-classes")
    decided = classes.filter("own is not null").groupBy("component_id").agg(F.min("own").alias("verdict"))  # allow stands before block
    return classes.join(decided, "component_id").select("key", "verdict")


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages`` (page_id, url and, for links, html)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.select("page_id", "url", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("own"))
    links = page_links(pages.select("url", "html")) if "html" in pages.columns else None
    if redirects is not None:
        given = redirects.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"))
        links = given if links is None else links.unionByName(given)
    ruled = rows.filter("own is not null").select("page_id", "host", "path", "own.rule", "own.verdict")
    open_ = rows.filter("own is null").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), alias_key(F.col("url")).alias("key"))
    if links is None:
        return ruled.unionByName(open_.drop("key").withColumn("verdict", F.lit("allow")))
    told = alias_verdicts(links, rules)
    # urls without :// have no class and stay out of the join
    met = open_.filter("key is not null").join(told, "key", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    none = open_.filter("key is null").drop("key").withColumn("verdict", F.lit("allow"))
    return ruled.unionByName(met).unionByName(none)


def _sql() -> str:
    def s(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def low(x: str) -> str:
        return f"translate({x}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

    def piece(x: str, k: int) -> str:
        return f"regexp_extract(coalesce({x}, ''), {s(URL)}, {k})"

    def rule(host: str, path: str, out: str) -> str:
        best = sorted(RULES, key=lambda r: (-len(r[0]) - len(r[1]), r))
        cases = " ".join(f"when ({host} = '{h}' or ends_with({host}, '.{h}')) and starts_with({path}, '{p}') then '{h + p if out == 'rule' else v}'" for h, p, v in best)
        return f"case {cases} end"

    def fold(path: str) -> str:
        walk = f"list_reduce(string_split({path}, '/')[2:], lambda d, x: case when x = '..' then regexp_replace(d, '/[^/]*$', '') when x = '.' then d else d || '/' || x end, '')"
        return (f"case when {path} = '' then '/' when regexp_matches({path}, {s(DOTS)}) then {walk} || case when string_split({path}, '/')[-1] in ('.', '..') then '/' else '' end "
                f"else {path} end")

    def key(x: str) -> str:
        return f"case when contains({x}, '://') then {low(piece(x, 1))} || '://' || {low(piece(x, 2))} || {fold(piece(x, 3))} || {piece(x, 4)} end"

    site = f"{piece('url', 1)} || '://' || {piece('url', 2)}"
    folder = f"case when {piece('url', 3)} = '' then '/' else regexp_replace({piece('url', 3)}, '[^/]*$', '') end"
    strip = lambda x: f"""replace(regexp_replace({x}, {s('^["' + "'" + r'\s]+|["' + "'" + r'\s]+$')}, '', 'g'), '&amp;', '&')"""
    tag = lambda tags, wanted: f"list_filter(regexp_extract_all(html, {s(tags)}), lambda t: regexp_matches(t, {s(wanted)}))[1]"
    other = r"(?i)^[a-z][a-z0-9+.-]*:($|[^/]|/[^/]|/$)"
    return f"""
with recursive seen as (select url, regexp_replace(html, {s(UNSEEN)}, '', 'g') as html from pages where contains(url, '://') and regexp_matches(lower(html), 'canonical|refresh')),
named as (select url, {strip(f"regexp_extract({tag(LINK, IS_CANONICAL)}, {s(HREF)}, 1)")} as t from seen
  union all select url, {strip(f"regexp_extract(regexp_extract({tag(META, IS_REFRESH)}, {s(CONTENT)}, 1), {s(TO)}, 1)")} from seen),
links as (select url as source, case when t = '' or starts_with(t, '#') or regexp_matches(t, {s(other)}) then null
    when regexp_matches(t, '(?i)^[a-z][a-z0-9+.-]*://') then t when starts_with(t, '//') then {piece('url', 1)} || ':' || t
    when starts_with(t, '/') then {site} || t when starts_with(t, '?') then {site} || {piece('url', 3)} || t else {site} || {folder} || t end as target from named where t is not null),
ends as (select {key('source')} as u, {key('target')} as v from links where target is not null),
both_ways as (select distinct u as a, v as b from ends where u <> v union select distinct v, u from ends where u <> v),
reach as (select distinct a as n, a as m from both_ways union select r.n, e.b from reach r join both_ways e on r.m = e.a),
told as (select n, min({rule(low(piece('m', 2)), piece('m', 3), 'verdict')}) as verdict from reach group by n),
rows as (select page_id, url, {low(piece('url', 2))} as host, {piece('url', 3)} as path from pages)
select page_id, host, path, {rule('host', 'path', 'rule')} as rule, coalesce({rule('host', 'path', 'verdict')}, told.verdict, 'allow') as verdict
from rows left join told on {key('rows.url')} = told.n"""


@query("op11_url_filter", _sql())
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))

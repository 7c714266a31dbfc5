"""URL filters with redirect equivalence: block decisions spread over components of redirect and canonical-link edges. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _components, _stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str]
_CANONICAL = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\burl\s*=\s*[\"']?([^\"'\s>]+)"


def after_scheme(url: Column) -> Column:
    """What follows the first ://, empty for null or none."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.lit(1 << 30))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """The resource that a url asks for: host, path (/ if empty) and query, without scheme and fragment; null if it has no host."""
    rest = F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(F.startswith(rest, F.lit("/")), "").otherwise("/"), rest))


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """A struct of rule and verdict: the longest rule (host/path) whose host is the url's or a parent domain of it, and whose path begins the url's; else null.

    rules: ("block" or "allow", "host/path"); they go into the plan as a map from host, so a url costs a look-up for each of its
    labels. Of a rule given twice, "allow" holds.
    """
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        by_host.setdefault(h.translate(str.maketrans(UPPER, LOWER)), []).append((slash + p, rule, verdict))
    if not by_host:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    entry = lambda x: F.struct(F.lit(x[0]).alias("path"), F.lit(x[1]).alias("rule"), F.lit(x[2]).alias("verdict"))
    table = F.create_map(*[y for h, xs in by_host.items() for y in (F.lit(h), F.array(*map(entry, xs)))])
    labels = F.split(host, r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    none = F.array().cast("array<struct<path:string,rule:string,verdict:string>>")
    fits = F.filter(F.flatten(F.transform(parents, lambda h: F.coalesce(F.try_element_at(table, h), none))), lambda r: F.startswith(path, r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), (r["verdict"] == "allow").alias("a"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def unescaped(x: Column) -> Column:
    """x with the entities that urls need as characters: XML's five, and reserved ones by number."""
    for ch, name in (('"', "quot"), ("'", "apos"), ("<", "lt"), (">", "gt"), *((c, None) for c in "/?#:;=%+,@!$()*[]-._~"), ("&", "amp")):
        x = F.regexp_replace(x, f"&(?:{f'{name}|' if name else ''}#0*{ord(ch)}|#[xX]0*(?i:{ord(ch):x}));", "\\$" if ch == "$" else ch)
    return x


def _without_dots(path: Column) -> Column:
    """A path that begins with a slash, its . and .. steps taken."""
    steps = F.slice(F.split(path, "/", -1), 2, 1 << 30)
    none = F.array().cast("array<string>")
    taken = F.aggregate(steps, none, lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(s == ".", a).otherwise(F.concat(a, F.array(s))))
    end = F.when(F.element_at(steps, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none)
    return F.concat(F.lit("/"), F.array_join(F.concat(taken, end), "/"))


def resolved(base: Column, target: Column) -> Column:
    """target as an absolute url, seen from base; null if it is empty or of a scheme without ://."""
    target = unescaped(F.trim(target))
    root = F.concat(F.substring_index(base, "://", 1), F.lit("://"), host_of(base))
    path, rest = F.regexp_extract(target, r"(?s)^[^?#]*", 0), F.regexp_extract(target, r"(?s)^[^?#]*(.*)", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path_of(base), r"(?s)^/(.*/)?", 1))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when((target == "") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(F.startswith(target, F.lit("//")), F.concat(F.substring_index(base, "://", 1), F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(root, _without_dots(path), rest))
        .when(path == "", F.concat(root, path_of(base), rest))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, path)), rest))
    )


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): nodes that a page declares to be the same, by its canonical links and refresh redirects."""
    every = F.concat(*[F.regexp_extract_all(html, F.lit(x), F.lit(1)) for x in (_CANONICAL, _REFRESH)])
    found = pages.select(F.col(url).alias("u"), F.explode(every).alias("t"))
    return found.where("t <> ''").select(node_of(F.col("u")).alias("a"), node_of(resolved(F.col("u"), F.col("t"))).alias("b")).where("a <> b").distinct()


def judge(pages: DataFrame, rules: list[Rule], edges: DataFrame | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """pages with host, path, rule and verdict.

    A url's own rule comes first, so an explicit allow (or block) is never overridden. A url without a rule is blocked if a node of
    its component is blocked by a rule; else it is allowed. Urls that differ in scheme or fragment only are one node. edges
    (a, b: nodes) may bring a redirect log; by default pages' own canonical links and refreshes are read. A null url, or one
    without ://, has empty host and path, no rule, and is allowed; null html has no links. Repeated rows are judged alike, extra
    columns stay, and columns named like the results are replaced.
    """
    own = _stage.Own(pages)
    u, given = F.col(own.of(url)), edges
    x = own.df.withColumns({"host": host_of(u), "path": path_of(u), "node": node_of(u)})
    x = x.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
    edges = alias_edges(own.df, own.of(url), own.of(html)) if given is None else given.select(*[node_of(F.concat(F.lit("://"), e)).alias(e) for e in ("a", "b")])
    joined = _components.components(edges)
    as_url = F.concat(F.lit("://"), F.col("node"))
    ruled = joined.withColumn("rule", matched_rule(host_of(as_url), path_of(as_url), rules))
    bad = ruled.where("rule.verdict = 'block'").select("root").distinct()
    blocked = joined.join(bad, "root", "left_semi").select("node", F.lit(True).alias("alias"))
    x = x.join(blocked, "node", "left")
    verdict = F.coalesce("rule.verdict", F.when(F.col("alias"), F.lit("block")), F.lit("allow"))
    return x.select(*own.back("host", "path", "rule", "verdict"), "host", "path", F.col("rule.rule").alias("rule"), verdict.alias("verdict"))

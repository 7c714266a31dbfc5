"""Alias edges of pages in all the forms that html has for them."""

from __future__ import annotations

from beamgrid.llm import url_filter


def test_alias_forms(spark):
    rows = [
        ("http://h.org/d/1", '<meta http-equiv="refresh" content="0; url=/a?x=1&amp;y=2;z">', "h.org/a?x=1&y=2;z"),
        ("http://h.org/d/2", '<link rel="canonical" href="next.html">', "h.org/d/next.html"),
        ("http://h.org/d/3?q", '<link rel="canonical" href="?p=2#f">', "h.org/d/3?p=2"),
        ("http://h.org/d/4", '<link rel="canonical" href="../x">', "h.org/x"),
        ("http://h.org/d/5", '<link rel="canonical" href="/x&#x2F;y"><link rel="canonical" href="//g.org">', "h.org/x/y"),
        ("http://h.org/d/5", "", "g.org/"),
        ("http://h.org/d/6", '<link rel="canonical" href="mailto:a">', None),
        ("http://h.org", '<link rel="canonical" href="http://h.org/">', None),
    ]
    got = url_filter.alias_edges(spark.createDataFrame([r[:2] for r in rows], "url string, html string")).collect()
    want = {(url_filter_node(u), b) for u, _, b in rows if b}
    assert {(r.a, r.b) for r in got} == want


def url_filter_node(url):
    return url.split("://")[1]

import re

import pytest

from draftweave.llm import urls
from draftweave.llm.queries import RULES

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "page_id long, url string, html string, host string, path string, rule string, node string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "x", "x", "x") for i, u, h in rows], SCHEMA)


def rules(spark, given=RULES):
    return spark.createDataFrame(given, "host string, path string, action string")


def cut(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate(UPPER), m[2]) if m else ("", "")


def rule_of(url):
    host, path = cut(url)
    fit = [(len(h + p), a == "allow", h + p, a) for h, p, a in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[2:] if fit else (None, None)


ROWS = [
    (0, None, None), (1, "", ""), (2, "no scheme net/", None), (3, "HTTP://A.Net/x", ""), (4, "x://net", None), (5, "http://y.net/", None),
    (6, "http://a.example.net/en/1", None), (7, "http://a.example.net/EN/1", None), (8, "http://badexample.com/de/", None),
    (9, "http://b.example.com/de/x?y://org/fr/", None), (10, "http://q.org/fr/://x", None), (11, "http://q.org?/fr/", None), (12, "http://É.ORG/fr/", None),
    (13, "x\ny://k.org/fr/\nz#q", None), (14, "http://k.org/fr/", "<p>"), (14, "http://k.org/fr/", "<p>"), (None, "://net/a", None),
]


def test_rules_equal_brute_force(spark):
    got = sorted(((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in urls.judged(pages(spark, ROWS), rules(spark)).collect()), key=str)
    assert got == sorted(((str(i), *cut(u), rule_of(u)[0], rule_of(u)[1] or "allow") for i, u, _ in ROWS), key=str)


def link(url):
    return f'<html><head><link rel="canonical" href="{url}"></head>'


ALIASES = [
    # A chain from a page without a rule to a blocked one.
    (0, "http://a.site/1", link("http://b.site/1")), (1, "http://b.site/1", "<META http-equiv='refresh' content='0; URL=//c.example.com/de/9'>"),
    # The same with an explicit allow among the aliases.
    (2, "http://d.site/1", link("http://e.net/1")), (3, "http://f.site/1", link("http://d.site/1")), (4, "http://d.site/1", link("http://g.org/fr/1")),
    # A rule of its own stands whatever its aliases are.
    (5, "http://h.net/1", link("http://i.org/fr/")), (6, "http://j.org/fr/2", link("http://k.net/2")),
    # Relative links, entities, mirrors and tracking parameters.
    (7, "http://l.site/x/y", link("/x/z?a=1&amp;b=2")), (8, "http://www.l.site/x/z/?a=1&b=2&utm_source=q#f", link("z")), (9, "http://l.site/x/z?a=1&b=2", link("http://m.net/")),
    # Comments on links that are none.
    (10, "http://n.site/", '<a rel="canonical" href="http://o.net/">'), (11, "http://p.site/", '<link rel="icon" href="http://o.net/">'), (12, "http://q.site/", link("")),
]


def test_decisions_reach_aliases(spark):
    got = {r.page_id: r.verdict for r in urls.judged(pages(spark, ALIASES), rules(spark)).collect()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "block", 6: "allow",
                   7: "block", 8: "block", 9: "block", 10: "allow", 11: "allow", 12: "allow"}


@pytest.mark.parametrize("given", [RULES, []])
def test_empty_tables(spark, given):
    assert urls.judged(pages(spark, []), rules(spark, given)).count() == 0
    assert {r.verdict for r in urls.judged(pages(spark, ALIASES[10:]), rules(spark, given)).collect()} == {"allow"}

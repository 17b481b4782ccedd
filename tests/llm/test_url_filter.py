import random
import re

import duckdb
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from almanac.llm import url_filter as uf
from almanac.llm.oracle import oracle_sql
from almanac.llm.queries import queries


def as_pattern(glob):
    parts = re.split(r"(\*+)", glob)
    wild = {1: "[^/?]*"}
    return re.compile("".join(
        wild.get(len(p), ".*") if p.startswith("*") else re.escape(p) for p in parts
    ), re.DOTALL)


def test_automaton_equals_patterns():
    draw = random.Random(0)
    globs = ["".join(draw.choice("ab/.**?é") for _ in range(draw.randint(0, 9))) for _ in range(150)]
    globs += ["a" * 130 + "*b", "**" + "ab" * 70, "", "*", "**"]
    automaton = uf.Automaton([uf.Rule(str(i), "block", (g,), 0) for i, g in enumerate(globs)])
    urls = ["".join(draw.choice("ab/.?é") for _ in range(draw.randint(0, 12))) for _ in range(300)]
    urls += ["", "a" * 130 + "xb", "x/" + "ab" * 70, "a" * 20_000]
    hit = automaton.matches([u.encode() for u in urls])
    for u, row in zip(urls, hit, strict=True):
        assert row.tolist() == [bool(as_pattern(g).fullmatch(u)) for g in globs]


@pytest.mark.parametrize("url,host,path", [
    ("https://WWW.Example.net/En/a?x=/y#z", "www.example.net", "/En/a"), ("http://a.de", "a.de", ""),
    ("http://a.de?x/y", "a.de", ""), ("http://a.de#/x", "a.de", ""), ("nothing", "", ""), (None, "", ""),
    ("", "", ""), ("x://y://z/w", "y:", "//z/w"), ("://h/p\nq", "h", "/p\nq"), ("http:///p", "", "/p"),
    ("http://ÄB.de/ä", "Äb.de", "/ä"), ("http://a.de/" + "x" * 50_000, "a.de", "/" + "x" * 50_000),
])
def test_parts(spark, url, host, path):
    row = spark.createDataFrame([(url,)], "url string").select(
        *(c.alias(n) for n, c in uf.parts(F.col("url")).items())
    ).first()
    assert (row["host"], row["path"]) == (host, path)


RULES = [
    uf.domain_rule("net", "/", "block"), uf.domain_rule("example.net", "/en/", "allow"),
    uf.domain_rule("example.com", "/de/", "block"), *uf.glob_rules(["*spam**", "**.exe"], "block"),
]


def plain_verdict(url):
    url = url or ""
    rest = url.partition("://")[2] if "://" in url else ""
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    best = None
    for name, h, p, verdict in (("net/", "net", "/", "block"), ("example.net/en/", "example.net", "/en/", "allow"),
                                ("example.com/de/", "example.com", "/de/", "block")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(name) > len(best[0])):
            best = (name, verdict)
    if best:
        return best
    query = re.match(r"[^?#]*((?:\?[^#]*)?)", rest)[1]
    whole = host + path + query
    for g in sorted(("*spam**", "**.exe"), key=len, reverse=True):
        if as_pattern(g).fullmatch(whole):
            return (g, "block")
    return (None, "allow")


def test_longest_rule_decides(spark):
    urls = [
        "http://a.net/", "http://a.net", "http://net/x", "http://anet/x", "http://example.net/en/x",
        "http://m.example.net/en/", "http://example.net/en", "http://notexample.net/en/x", "http://example.com/de/",
        "http://example.com/DE/", "http://EXAMPLE.com/de/x", "http://spam.org/", "http://a.org/spam", "http://a.org/x.exe",
        "http://a.org/x.exe?y", "http://a.org/net/x.net/y", "http://a.org?x.exe", None, "", "junk", "http://a.net?/", "a.net/",
    ]
    rows = spark.createDataFrame([(u, "x", "x") for u in urls * 2], "url string, rule string, verdict string")
    found = [tuple(r[0]) for r in rows.select(uf.judge(F.col("url"), RULES)).collect()]
    assert found == [plain_verdict(u) for u in urls * 2]
    assert rows.limit(0).select(uf.judge(F.col("url"), RULES)).count() == 0
    alone = rows.select(uf.judge(F.col("url"), [], otherwise="block")).distinct().collect()
    assert [tuple(r[0]) for r in alone] == [(None, "block")]


def test_wildcards_in_domain_rules_are_refused():
    with pytest.raises(ValueError):
        uf.domain_rule("*.net", "/", "block")


@pytest.mark.parametrize("sf", [SF_DIR, "/root/testdata/sf0.1"])
def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    out = queries()["op9_url_filter"](spark, sf)
    sql = con.execute(oracle_sql()["op9_url_filter"])
    columns = [c[0] for c in sql.description]
    assert sorted(columns) == sorted(out.columns)
    assert sorted(map(str, map(tuple, out.select(*columns).collect()))) == sorted(map(str, sql.fetchall()))

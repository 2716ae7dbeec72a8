import re

import pytest
from llm_util import empty
from oracle_util import compare, duck
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF_SMALL
from gavel.llm import urls as U
from gavel.llm.queries import ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_oracle(spark, name):
    ok, said = compare(entry.queries()[name](spark, SF_SMALL), duck(SF_SMALL), entry.oracle_sql()[name])
    assert ok, said


def test_plan_is_native(spark):
    got = U.op9_urls(spark, SF_SMALL)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


CASES = {
    None: ("", "", None, "allow"), "nope": ("", "", None, "allow"), "http://NET/x": ("net", "/x", "net/", "block"),
    "http://a.net": ("a.net", "", None, "allow"), "http://a.net?x=/": ("a.net", "", None, "allow"),
    "http://a.Example.net/en/x": ("a.example.net", "/en/x", "example.net/en/", "allow"),
    "http://a.example.net/EN/x": ("a.example.net", "/EN/x", "net/", "block"),
    "http://casino.example.org/fr/a": ("casino.example.org", "/fr/a", "org/fr/", "allow"),
    "x://www.online-casino.org:80/a": ("www.online-casino.org:80", "/a", None, "block"), "http://bets": ("bets", "", None, "block"),
    "http://alphabet.org/bet/": ("alphabet.org", "/bet/", None, "allow"), "http://planet/": ("planet", "/", None, "allow"),
    "http://a/b://c.net/": ("a", "/b://c.net/", None, "allow"), "": ("", "", None, "allow"), "http://": ("", "", None, "allow"),
    "http://x.net/" + "a/" * 30_000: ("x.net", "/" + "a/" * 30_000, "net/", "block"),
}


def test_awkward_urls(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(CASES)] * 2 + [(None, "http://bets")], "page_id long, url string")
    pages = pages.withColumns({"host": F.lit("mine"), "token": F.lit(1)})
    got = U.judge(pages, U.default_rules(spark)).withColumn("site", F.when(F.col("priority") == 2, F.col("rule"))).collect()
    assert len(got) == 2 * len(CASES) + 1
    for r in got:
        assert (r.host, r.path, r.site, r.verdict) == CASES[r.url]
    assert U.judge(empty(pages), U.default_rules(spark)).count() == 0
    assert {r.verdict for r in U.judge(pages, empty(U.default_rules(spark)), default="block").collect()} == {"block"}


def test_rarest_token_fetches_every_rule_that_fits(spark):
    """Against running every rule's expression on every URL."""
    urls = [f"http://{a}.{b}.com/{c}/x" for a in ("shop", "news") for b in ("one", "two-three") for c in ("p", "q", "shop")]
    rules = [("r1", "block", 1, 2, r"^shop\.", ["shop"]), ("r2", "block", 1, 3, r"two-three\.com/q", ["two", "three", "com", "q"]),
             ("r3", "allow", 2, 1, r"/shop/x$", ["shop", "x"]), ("r4", "block", 1, 9, r"never", ["never", "com"])]
    got = {r.url: r.rule for r in U.verdicts(spark.createDataFrame([(u,) for u in urls * 2], "url string"),
                                            spark.createDataFrame(rules, U.RULE_SCHEMA)).collect()}
    want = {}
    for u in urls:
        site = u.split("://")[1]
        best = max(((p, n, name) for name, _, p, n, pattern, _ in rules if re.search(pattern, site)), default=None)
        if best:
            want[u] = best[2]
    assert got == want

"""Rules, features and held-out accuracy of the URL filter."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from clientele.llm import url_filter
from clientele.llm.catalog import runs
from clientele.llm.common import stage
from clientele.llm.url_filter import (PRIOR, RULES, _fold, _signs, entropy, featured, host_of, judge_urls, path_of,
                                      suffix_statistics)

URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/1?x=1#y", "http://example.net/EN/", "x://net/", "x://net",
        "x://a.net?q", "https://example.com/de/5", "https://example.com.evil/de/", "http://notexample.com/de/",
        "http://fr.org/fr/", "http://org/fr/x", "http://u@h.org:80/fr/", "a://b://c/d", "http://ÄÖ.net/é\n/x", "x://net#/"]


def slow(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")


def test_hosts_paths_and_rules(spark):
    urls = URLS * 2
    out, judged = judge_urls(pages(spark, urls))
    assert out.columns == ["page_id", "url", "host", judged]
    got = {r["page_id"]: r[judged] for r in out.collect()}
    assert sorted(got) == list(range(len(urls)))
    for i, u in enumerate(urls):
        host, path, rule, verdict = slow(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == verdict if rule else got[i]["verdict"] in ("allow", "block")
        assert got[i]["by_model"] == (rule is None)


def test_empty_table_and_one_class(spark):
    out, judged = judge_urls(pages(spark, []))
    assert out.count() == 0
    out, judged = judge_urls(pages(spark, ["http://plain.com/a", "http://other.com/b"]))
    assert {r[judged]["verdict"] for r in out.collect()} == {"allow"}


def test_entropy(spark):
    texts = ["", "a", "ab", "aab", "éé.x", "a.b[c"]
    want = [-sum(t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t)) for t in texts]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
           .select(F.coalesce(entropy(F.col("t")), F.lit(0.0))).collect()]
    assert got == pytest.approx(want, abs=1e-9)


def test_held_out_accuracy(spark):
    """Hosts whose word is not on the list are blocked by what they share with those that are."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("thernaodis") for _ in range(rng.randint(5, 9)))
    known, unknown = ["pills", "bets", "casino", "win", "ads", "viagra"], ["roulette", "jackpot", "crypto"]
    shop = lambda: f"{rng.choice(known + unknown)}-{rng.choice(['shop', 'now', 'best', 'online', 'club', 'deal'])}{rng.randint(1, 99)}"
    urls, truth = [], []
    for i in range(1500):
        is_bad = rng.random() < 0.2
        host = f"www.{shop()}.example.com" if is_bad else f"blog.{word()}.example.com"
        urls.append(f"https://{host}/{rng.choice(['en', 'es'])}/{i}{rng.choice(['', '?page=2&ref=x', '#top'])}")
        truth.append("block" if is_bad else "allow")
    assert not set(unknown) & set(url_filter.BAD_WORDS)
    out, judged = judge_urls(pages(spark, urls))
    got = {r["page_id"]: r[judged]["verdict"] for r in out.collect()}
    right = sum(got[i] == t for i, t in enumerate(truth)) / len(truth)
    assert right > 0.95
    hidden = [i for i, u in enumerate(urls) if any(w in u for w in unknown)]
    assert hidden and sum(got[i] == "block" for i in hidden) / len(hidden) > 0.4  # measured: 0.47


def test_suffix_features_come_from_other_folds(spark):
    urls = [f"http://h{i}.{'casino' if i % 3 else 'plain'}.com/{i}" for i in range(60)] + ["http://casino.org/fr/1", None]
    rows = stage(_signs(spark.createDataFrame([(u,) for u in urls], "url string"), RULES).withColumn(
        "fold", _fold(F.col("url"))), "signs")
    got = featured(rows, suffix_statistics(rows)).collect()
    assert sorted(str(r["url"]) for r in got) == sorted(map(str, urls))
    for r in got:
        for key in ("suffix", "domain"):
            mine = [x["label"] for x in got if x[key] == r[key] and x["fold"] != r["fold"] and x["label"] is not None]
            assert r[f"{key}_block"] == pytest.approx((sum(mine) + PRIOR / 2) / (len(mine) + PRIOR))
            assert r[f"{key}_seen"] == pytest.approx(math.log1p(len(mine)))


def test_query_gives_rules_and_every_page(spark):
    sf = "/root/testdata/sf0.001"
    out = runs()["op5_url_filter"](spark, sf)
    got = {r["page_id"]: r for r in out.collect()}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 2 and not any("url" in line for line in joins)
    for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect():
        host, path, rule, verdict = slow(r["url"])
        mine = got.pop(r["page_id"])
        assert (mine["host"], mine["path"], mine["rule"]) == (host, path, rule)
        assert mine["verdict"] == verdict if rule else mine["verdict"] in ("allow", "block")
    assert not got


def test_very_long_url(spark):
    url = "http://" + "a" * 50_000 + ".net/" + "b" * 200_000
    row = pages(spark, [url]).select(F.char_length(host_of(F.col("url"))), F.char_length(path_of(F.col("url")))).first()
    assert tuple(row) == (50_004, 200_001)

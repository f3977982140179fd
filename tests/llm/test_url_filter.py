import random
import re

import numpy as np
from pyspark.sql import functions as F

from kindred.llm.url_filter import RULES, _hashed, build, judge

PAGES = "page_id long, url string, host int, path string, keys string, verdict string"


def brute_force(pages, rules, default="allow"):
    out = []
    for page_id, url, *_ in pages:
        host = path = ""
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h) + len(p), h.count("."), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            best = max(fits)[:3]
            verdict = "block" if any(f[:3] == best and f[3] == "block" for f in fits) else "allow"
        out.append((page_id, host, path, best[2] if fits else None, verdict if fits else default))
    return sorted(out, key=str)


def found(spark, pages, rules, **options):
    rows = judge(spark.createDataFrame(pages, PAGES), spark.createDataFrame(rules, "host string, path string, verdict string"), **options).collect()
    return sorted([(r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows], key=str)


URLS = [
    None, "", "no scheme/x", "http://", "://org/", "http://org", "http://ORG/a", "http://xorg/", "ftp://a.Example.org/es/", "http://example.org/es", "http://example.org/en/12?q#f",
    "http://example.org/en/2", "http://notexample.org/en/1", "http://example.org?x=/es/", "http://example.org#/es/", "http://é.com/fr/ü", "http://a..com/de/", "http://com/de/", "http://a.com:80/de/",
    "x://y://example.org/es/", "http://a.com/DE/", "http://com./de/", "http://a.net/" + "x" * 50_000, "http://" + "a." * 5_000 + "com/fr/1", "line\n://b.com/de/\nmore",
]


def made(urls):
    return [(i if i % 11 else None, u, 1, "p", "k", "v") for i, u in enumerate([*urls, *urls[:4]])]


def test_the_rules_of_the_query(spark):
    pages = made(URLS)
    assert found(spark, pages, RULES) == brute_force(pages, RULES)
    assert found(spark, pages, [], default="block") == brute_force(pages, [], "block")
    assert found(spark, [], RULES) == []


def test_many_rules_in_one_and_in_several_segments(spark):
    draw = random.Random(7)
    label = lambda: draw.choice(["a", "b", "c", "shop", "x"])
    host = lambda n: ".".join(label() for _ in range(n)) + "." + draw.choice(["com", "org"])
    rules = [(host(draw.randrange(3)) if draw.random() < 0.9 else "org", "/" + "abc"[: draw.randrange(4)], draw.choice(["allow", "block"])) for _ in range(300)]
    rules += [("both.com", "/", "allow"), ("both.com", "/", "block"), ("", "/", "block"), ("Case.ORG", "/P", "block")]
    pages = made([f"http://{host(draw.randrange(4))}/{draw.choice(['', 'a', 'ab', 'abc', 'abcd', 'b'])}" for _ in range(1500)] + ["http://both.com/", "http://x.case.org/Pq"])
    want = brute_force(pages, [(h.lower(), p, v) for h, p, v in rules])
    assert found(spark, pages, rules) == want
    assert found(spark, pages, rules, max_bytes=90) == want


def test_a_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(60_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.filter("cast(substr(key, 2) as int) % 29 = 0")
    cascade, = build(listed, universe.union(listed))
    assert len(cascade.levels) > 3 and cascade.n_bytes < 60_000 // 29 * 2
    rows = _hashed(universe).toPandas()
    says = cascade.listed(rows["h1"].to_numpy(), rows["h2"].to_numpy())
    assert np.array_equal(says, rows["key"].str[1:].astype(int).to_numpy() % 29 == 0)

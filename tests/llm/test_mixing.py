from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import mixing


def brute_targets(sizes, most=3.0):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > most * sizes[s] + 1e-9]
        if not over:
            return fixed | {s: weight[s] * level for s in free}
        fixed |= {s: most * sizes[s] for s in over}


def documents():
    rng = np.random.default_rng(2)
    rows = []
    for s, n in [("a", 200), ("b", 3000), ("B", 30), ("é", 400), (None, 100), ("tiny", 2), ("empty", 3)]:
        for _ in range(n):
            words = 0 if s == "empty" else int(rng.integers(0, 60))
            rows.append((len(rows), " ".join(["x"] * words) if words or s == "empty" else None, s, "clash", 7))
    rows += [(1, "x " * 9, "a", "clash", 7)] * 50 + [(None, "x x", "a", "clash", 7)] * 3
    return rows


def test_targets_and_taken(spark):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard string, part int")
    sizes = Counter()
    for _, t, s, *_ in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    got = mixing.mix_report(df).collect()
    assert len(got) == len(rows)
    by = {}
    source = {d: s for d, _, s, *_ in rows} | {None: "a"}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s])
        assert r.taken <= 3 * r.size
        by[s] = by.get(s, 0) + r.taken
    for s, words in by.items():
        assert abs(words - want[s]) <= max(3, 0.01 * want[s]), (s, words, want[s])
    again = mixing.mix_report(df.repartition(3)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.taken, r.draws)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_tree_meets_quotas(spark):
    rows = [(s, p, b) for s, n in [("a", 40), ("b", 7), (None, 100)] for p in (1, 2) for b in range(n)]
    out = mixing._split(spark.createDataFrame(rows, "source string, pass int, block long"), 3, 0).collect()
    assert Counter((r.source, r["pass"], r.block) for r in out) == Counter(rows)
    count = Counter(r.shard for r in out)
    assert set(count) == set(range(8)) and max(count.values()) - min(count.values()) <= 3


def test_mix_has_the_rows_of_the_plan(spark):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, part int")
    mix = mixing.mixed(df)
    assert mix.columns == [*df.columns, "shard", "place"]
    out = mix.collect()
    words = Counter()
    for r in out:
        words[r.source] += len((r.text or "").split())
    sizes = Counter()
    for _, t, s, *_ in rows:
        sizes[s] += len((t or "").split())
    for s, want in brute_targets(sizes).items():
        assert abs(words[s] - want) <= max(3, 0.01 * want)
    assert len({(r.shard, r.place) for r in out}) == len(out)
    assert mixing.mixed(df.limit(0)).count() == 0
    assert mixing.mix_report(df.limit(0)).count() == 0


def test_rows_that_differ_in_nulls_alone_stay_apart(spark):
    rows = [(i, "w " * 5, *pair) for i in range(40) for pair in (("en", None), (None, "en"))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = [tuple(r)[:4] for r in mixing.mixed(df, most=1.0).collect()]
    assert Counter(out) == Counter(rows)


def test_clashing_names(spark):
    names = ["row", "taken", "_copy", "own", "draw", "_n", "_i", "block", "part", "passes", "size", "target", "s", "n"]
    rows = [(i, "w " * (i % 7), "ab"[i % 2], *range(len(names))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    out = mixing.mixed(df)
    assert out.columns == [*df.columns, "shard", "place"] and set(tuple(r)[:-2] for r in out.collect()) <= set(rows)
    assert mixing.mix_report(df).count() == 60
    with pytest.raises(ValueError):
        mixing.mixed(out)


def test_many_copies_are_numbered_in_ranges(spark):
    df = spark.createDataFrame([("a", 9000), ("b", 1), ("c", 4096), ("d", 4097)], "k string, n long")
    got = mixing.numbered(df, F.lit(5).cast("long"), "n", "at").collect()
    by = {}
    for r in got:
        by.setdefault(r.k, []).append(r["at"])
    assert {k: sorted(v) for k, v in by.items()} == {k: list(range(5, 5 + n)) for k, n in (("a", 9000), ("b", 1), ("c", 4096), ("d", 4097))}


def test_draws_as_brute_force(spark):
    """Whole passes and blocks: what each document is drawn, from the plan's own hashes."""
    rows = [(i, "w " * (1 + i * 7 % 13), "abc"[i % 3] if i % 11 else "d") for i in range(900)]
    got = {r.doc_id: r for r in mixing.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = brute_targets(sizes)
    for s in sizes:
        own = [(got[i], len(t.split())) for i, t, x in rows if x == s]
        passes = min(3, int(want[s] // sizes[s] + 1e-9))
        draws = [len(r.draws) for r, _ in own]
        assert set(draws) <= {passes, passes + 1} and max(draws) <= 3  # whole passes take all, the part pass some
        extra = sum(n for (r, n), d in zip(own, draws, strict=True) if d > passes)
        assert abs(extra - (want[s] - passes * sizes[s])) <= max(n for _, n in own) / 2 + 1
    # The tree deals every pass over the shards as evenly as a draw without replacement.
    per = Counter(x for r in got.values() for x in r.draws)
    assert set(per) <= set(range(16)) and sum(per.values()) == sum(len(r.draws) for r in got.values())

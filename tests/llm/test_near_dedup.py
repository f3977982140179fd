import itertools
import random

import numpy as np

from kindred.llm import near_dedup
from kindred.llm.near_dedup import deduplicate, maps_allow, parity_map

SF = "/root/testdata/sf0.001"


def brute_shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(docs):
    """The rows that stay: links between all pairs at 0.8 or more, and the least key of each component."""
    label = list(range(len(docs)))
    sets = [brute_shingles(d[1]) for d in docs]

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(docs)), 2):
        x, y = sets[i], sets[j]
        if (not x and not y) or (x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y) - 1e-9):
            label[root(j)] = root(i)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(root(i), []).append(docs[i])
    return sorted((min(g, key=lambda d: (d[0] is None, d[0] or 0)) for g in groups.values()), key=str)


def test_planted_copies_and_edges(spark):
    draw = random.Random(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    docs = []
    for n in (3, 5, 6, 12, 40, 150, 600):
        for _ in range(12):
            docs.append(draw.choices(vocabulary, k=n))
    for words in list(docs):  # an edit in about every 60 words keeps about 0.85
        for _ in range(3):
            copy = list(words)
            for _ in range(max(1, len(copy) // 60)):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            docs.append(copy)
    rows = [(i, " ".join(w) if i % 5 else "\t".join(w).upper(), "s", i) for i, w in enumerate(docs)]
    chain = draw.choices(vocabulary, k=400)
    for i in range(150):  # a dense group whose ends are far apart
        chain[i * 2] = draw.choice(vocabulary)
        rows.append((5000 + i, " ".join(chain), "s", i))
    rows += [(None, None, None, None), (7000, None, "s", 1), (7001, "  ", "s", 1), (7002, "", "s", 1), (None, "solo words here", "s", 2), rows[0], rows[0]]
    schema = "doc_id long, text string, who string, node long"
    got = sorted([tuple(r) for r in deduplicate(spark.createDataFrame(rows, schema)).collect()], key=str)
    want = brute_kept(rows)
    assert len({str(r) for r in got} - {str(r) for r in want}) <= 0.02 * len(want) and len(got) <= 1.02 * len(want)
    assert {str(r) for r in want} <= {str(r) for r in got}  # what is not similar is never dropped
    assert deduplicate(spark.createDataFrame([], schema)).count() == 0


def test_recall_and_no_false_link_on_the_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r[0] for r in deduplicate(spark.read.parquet(f"{SF}/documents.parquet")).select("doc_id").collect()}
    want = {d[0] for d in brute_kept(docs)}
    assert want <= got and len(docs) - len(got) >= 0.9 * (len(docs) - len(want)) and len(want) < len(docs)


def test_parity_maps_drop_no_similar_pair_and_most_others():
    draw = np.random.default_rng(5)
    sets = [np.zeros(0, np.uint64)]
    for size in (1, 5, 30, 130, 700, 3000, 20_000):
        whole = draw.integers(0, 1 << 63, size, np.uint64)
        for share in (0, 0.02, 0.05, 0.1, 0.11, 0.12, 0.2, 0.4):
            own = whole.copy()
            own[: int(share * size)] = draw.integers(0, 1 << 63, int(share * size), np.uint64)
            sets.append(np.unique(own[int(share * size / 5) :]))
    i, j = map(np.array, zip(*itertools.combinations(range(len(sets)), 2)))
    allowed = maps_allow(np.array([len(s) for s in sets]), [parity_map(s) for s in sets], i, j)
    shared = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]
    alike = np.array([10 * s >= 8 * (len(sets[a]) + len(sets[b]) - s) for s, a, b in zip(shared, i, j)])
    assert alike.any() and allowed[alike].all() and (allowed & ~alike).sum() < 0.02 * (~alike).sum() + 5


def test_a_group_of_near_texts_below_the_similarity_gives_few_pairs(spark, monkeypatch):
    draw = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):  # one edit in about 19 words: two texts share about 0.6
        rows.append((i, " ".join(f"x{i}-{k}" if draw.random() < 0.05 else w for k, w in enumerate(base))))
    seen, linked = [], near_dedup._linked
    monkeypatch.setattr(near_dedup, "_linked", lambda pairs, sets: seen.append(pairs.count()) or linked(pairs, sets))
    got = deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(brute_kept(rows)) and max(seen) < 10 * len(rows)


def test_texts_reach_python_a_few_at_a_time_and_the_setting_comes_back(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(name), {}
    written = near_dedup.materialize
    monkeypatch.setattr(near_dedup, "materialize", lambda df, table: seen.setdefault(table, spark.conf.get(name)) and written(df, table))
    rows = [(i, " ".join(f"w{i // 2}-{k}" for k in range(60)) + " end" * (i % 2)) for i in range(40)]
    got = deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(brute_kept(rows)) == 20 and spark.conf.get(name) == before
    assert int(seen["prints"]) <= 500 and int(seen["shingles"]) <= 500

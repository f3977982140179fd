from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from kindred.llm import decontaminate


def words(text):
    return [w for w in (text or "").lower().replace("\n", " ").replace("\t", " ").split(" ") if w]


def shingles(w, width):
    return Counter(" ".join(w[i : i + width]) for i in range(len(w) - width + 1))


def brute(docs, bench):
    """Pairs with a window of the item's size at 0.8 or more, over every window."""
    out = {}
    for d, text in docs:
        w = words(text)
        for i, item in bench:
            iw = words(item)
            if not iw:
                continue
            width = min(5, len(iw))
            b = shingles(iw, width)
            # A window shares no more with the item than it has places whose shingle the item has.
            held = [0]
            for s in range(len(w) - width + 1):
                held.append(held[-1] + (next(iter(shingles(w[s : s + width], width))) in b))
            places = len(iw) - width + 1
            for s in range(len(w) - len(iw) + 1):
                if 1.8 * (held[s + places] - held[s]) < 1.6 * places - 1e-6:
                    continue
                a = shingles(w[s : s + len(iw)], width)
                sim = sum((a & b).values()) / sum((a | b).values())
                if sim >= 0.8 - 1e-9:
                    out[d, i] = max(out.get((d, i), 0), sim)
    return out


def case():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    bench = [(i, text(n)) for i, n in enumerate([12, 25, 25, 40, 60, 3, 1, 5])] + [(90, ""), (91, None), (92, "again and " * 14)]
    bench[6] = (6, "rareword")
    docs = []
    for i, (_, item) in enumerate(bench[:8]):
        w = item.split()
        docs.append((100 + i, text(30) + "\n" + item.upper() + " " + text(20)))
        if len(w) > 20:
            edit = list(w)
            edit[0] = "edited"
            docs.append((200 + i, text(9) + " " + " ".join(edit) + " " + text(50)))
            docs.append((300 + i, " ".join(w[:-2] + ["x", "y"])))
            docs.append((400 + i, text(4) + " " + " ".join(w[: len(w) // 2])))
            docs.append((500 + i, " ".join(["in", *w[:10], "middle", *w[10:]])))
            docs.append((600 + i, " ".join(["z", *w[:-1], "in", "end"])))
    docs += [(700, None), (701, ""), (702, "again and " * 30), (703, text(400)), (None, "no id " + bench[1][1])]
    return docs, bench


def test_as_brute_force(spark):
    docs, bench = case()
    d = spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id long, text string, words string, n int")
    b = spark.createDataFrame([(*r, "clash") for r in bench + bench[:2]], "item_id long, text string, key string")
    want = brute(docs, bench)
    assert len(want) > 15
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(d, b).collect()}
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want)
    kept = {(r.doc_id, r.text) for r in decontaminate.clean_documents(d, b).collect()}
    bad = {k[0] for k in want}
    assert kept == {r for r in docs if r[0] not in bad}
    assert decontaminate.clean_documents(d, b).columns == d.columns


def test_shorter_texts_and_moved_parts(spark, monkeypatch):
    _, bench = case()
    docs = []
    for i, item in bench[1:5]:
        w = item.split()
        half = len(w) // 2
        docs += [(10 + i, " ".join(w[:-1])), (20 + i, " ".join(w[2:])), (30 + i, " ".join(w[: -len(w) // 6])), (40 + i, " ".join(w[:half]))]
        docs += [(50 + i, " ".join(["to", *w[half:], *w[:half], "end"])), (60 + i, " ".join([*w[-9:], *w[:-9]]))]
    want = {}
    for d, text in docs:
        for i, item in bench:
            w, iw = words(text), words(item)
            width = min(5, len(iw))
            for s in range(max(1, len(w) - len(iw) + 1)) if iw else ():
                a, b = shingles(w[s : s + len(iw)], width), shingles(iw, width)
                sim = sum((a & b).values()) / sum((a | b).values())
                if sim >= 0.8 - 1e-9:
                    want[d, i] = max(want.get((d, i), (0, 0)), (sim, len(w[s : s + len(iw)])))
    assert {(14, 4), (24, 4), (34, 4), (53, 3), (54, 4), (64, 4)} <= set(want) and len(want) < len(docs)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    for anchors in (decontaminate.INLINE_ANCHORS, 40):
        monkeypatch.setattr(decontaminate, "INLINE_ANCHORS", anchors)
        got = {(r.doc_id, r.item_id): (r.similarity, r.n_words) for r in decontaminate.contaminated(d, b).collect()}
        assert set(got) == set(want)
        assert all(abs(got[k][0] - want[k][0]) < 1e-5 and got[k][1] == want[k][1] for k in want)


def test_many_scans_find_the_same(spark, monkeypatch):
    docs, bench = case()
    docs = [r for r in docs if r[0] is None or r[0] < 300]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "INLINE_ANCHORS", 30)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()} == set(brute(docs, bench))


def test_blocks_hold_all_within_the_radius_and_few_others(spark):
    rng = np.random.default_rng(8)
    fps = rng.integers(-(2**63), 2**63 - 1, 400)
    near = []
    for fp in fps[:200]:
        flips = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 24), replace=False))
        near.append(int(np.int64(np.uint64(int(fp) & (2**64 - 1)) ^ np.uint64(flips))))
    left = np.concatenate([np.array(near), rng.integers(-(2**63), 2**63 - 1, 1800)])
    kinds = spark.createDataFrame([(str(i).encode(), 9, int(f)) for i, f in enumerate(left)], "key binary, n int, fp long")
    items = spark.createDataFrame([(i, b"", 9, int(f)) for i, f in enumerate(fps)], "item_id long, item binary, n int, item_fp long")
    got = {(int(r.key), r.item_id, r.differing_bits) for r in decontaminate._candidates(kinds, items, 15).collect()}
    bits = np.bitwise_count(left.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None])
    assert got == {(int(i), int(j), int(bits[i, j])) for i, j in np.argwhere(bits <= 15)}
    # Rows that meet in a block, of all pairs of a window and an item.
    own = kinds.select(F.explode(decontaminate._block_values(F.col("fp"))).alias("b"))
    met = own.join(items.select(F.explode(decontaminate._block_values(F.col("item_fp"), 3)).alias("b")), "b").count()
    assert met < 0.05 * len(left) * len(fps)


def test_simhash_as_majority(spark):
    rng = np.random.default_rng(2)
    lists = [[f"s{i}" for i in rng.integers(0, 50, n)] for n in (1, 2, 3, 8, 55, 400)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, s array<string>").select("i", decontaminate.simhash(F.col("s")).alias("fp")).collect()
    for r in got:
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in lists[r.i]]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert r.fp & (2**64 - 1) == want


def test_clashing_names_and_repeated_rows(spark):
    item = " ".join(f"w{i}" for i in range(20))
    names = "doc_id long, text string, id int, row int, key int, _bad int, item_id int, window int, hits int"
    rows = [(d, t, 1, None, 2, 3, 4, 5, 6) for d, t in [(1, item), (1, item), (1, "other words"), (2, "other words"), (2, "other words"), (None, None), (None, item), (3, "")]]
    d, b = spark.createDataFrame(rows, names), spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.clean_documents(d, b)
    assert kept.columns == d.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, "other words"), (2, "other words"), (2, "other words"), (None, None), (3, "")])


def test_empty(spark):
    d, b = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0
    assert decontaminate.contaminated(d.limit(0), b).count() == 0
    assert decontaminate.contaminated(d, b).count() == 1

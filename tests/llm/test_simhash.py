import itertools

import numpy as np
import xxhash

from kindred.llm import simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    n = min(4, len(words))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(range(len(fps)), 2):
            if bin(fps[i] ^ fps[j]).count("1") <= 4 and label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return label


def test_fingerprint():
    for text in ["", " \t\n", "One", "a b c", "The cat SAT on the mat " * 9, "Ünï code\x1fwörds ÀB x y z q"]:
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_gray_rank_is_inverse_of_gray_code():
    x = np.arange(1000, dtype=np.uint64)
    assert (simhash.gray_rank(x ^ (x >> np.uint64(1))) == x).all()


def test_index_links_as_brute_force():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = [int(c) for c in centres]
    for c in centres:
        for _ in range(25):
            fps.append(int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)))
    fps = list(dict.fromkeys(fps))
    order, label = simhash.link_groups(np.zeros(len(fps), np.int64), np.array(fps, np.uint64), 4)
    got = np.empty(len(fps), np.int64)
    got[order] = order[label]
    want = brute_components(fps)
    groups = lambda x: {frozenset(i for i, v in enumerate(x) if v == u) for u in set(x)}
    assert groups(got.tolist()) == groups(want)


def test_masks_cover_every_pair_within_radius():
    for m in (5, 6, 7):
        masks = [x & (1 << 64) - 1 for x in simhash.block_masks(m, 4)]
        rng = np.random.default_rng(m)
        for _ in range(200):
            diff = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(diff & x == 0 for x in masks)


def test_near_duplicates(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "   ", "single"]
    for _ in range(12):
        base = [str(w) for w in rng.choice(words, 120)]
        texts.append(" ".join(base))
        for k in range(6):
            edit = list(base)
            edit[int(rng.integers(0, 120))] = "changed"
            texts.append(" ".join(edit) if k else " ".join(base).upper())
    rows = [(i * 3 + 7, t, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, node int")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_components(fps)
    assert len(got) == len(rows)
    for (doc, *_), fp, label in zip(rows, fps, want, strict=True):
        assert got[doc].fingerprint == f"{fp:016x}"
        assert got[doc].component_id == rows[label][0]


def test_empty_and_null_keys(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0
    some = spark.createDataFrame([(None, "a b"), (4, "a b"), (2, "a b"), (2, "a b"), (None, "lonely")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(some).collect())
    assert got == [(-1, -1), (-1, 2), (2, 2), (2, 2), (4, 2)]


def test_deduplicate_keeps_one_row_of_each_component(spark):
    texts = ["a b c d e f g", "a b c d e f g", "other words stand in this text", None, ""]
    rows = [(9, texts[0], "x"), (4, texts[1], "y"), (4, texts[2], "z"), (4, texts[2], "z"), (None, texts[0], "n"), (8, texts[3], "p"), (6, texts[4], "q"), (None, "only null", "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _who string")
    got = sorted(map(str, (tuple(r) for r in simhash.deduplicate(df).collect())))
    assert got == sorted(map(str, [rows[1], rows[2], rows[6], rows[7]]))
    named = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert len({c for d, f, c in named if f == f"{brute_fingerprint(texts[2]):016x}"}) == 1

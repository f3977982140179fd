import hashlib
import random
import re

import pytest

from kindred.llm import line_dedup
from kindred.llm.common import join_groups


def units(text):
    """start, n of the chunks of several lines, and of the shortest run of over 50 words from each line with a word on."""
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    r = [(31 * x + (h[i - 1] if i else 0)) % 2147483647 for i, x in enumerate(h)]
    out, start = set(), 0
    for i in range(len(lines)):
        if i == len(lines) - 1 or (i >= 1 and r[i] < r[i - 1] and r[i] <= r[i + 1]):
            if i > start:
                out.add((start, i + 1 - start))
            start = i + 1
    for i in range(len(lines)):
        words = 0
        for j in range(i, len(lines) if lines[i].strip(" \t\r\x0b\x0c") else 0):
            words += len(re.findall(r"[^\x20\x09-\x0D]+", lines[j]))
            if words > 50:
                out.add((i, j + 1 - i))
                break
    return lines, sorted(out)


def brute(rows):
    """Texts by (doc_id, text) after removal of every unit but at its first place."""
    seen, result = set(), {}
    for doc, text in sorted({(d, t) for d, t in rows if t is not None}, key=lambda p: (p[0] is not None, p[0] or 0)):
        lines, own = units(text)
        gone = set()
        for start, n in own:
            unit = "\n".join(lines[start : start + n])
            if unit in seen:
                gone |= set(range(start, start + n))
            seen.add(unit)
        result[doc, text] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return result


def test_as_brute_force(spark):
    rng = random.Random(3)
    line = lambda: " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "é"], k=rng.randint(1, 9)))
    passage = [line() for _ in range(14)]
    rows = [(i, "\n".join([line() for _ in range(rng.randint(0, 9))] + passage + [line() for _ in range(rng.randint(0, 5))])) for i in range(30)]
    rows += [(100 + i, "\n".join(line() for _ in range(20))) for i in range(20)]
    # Passages of over 50 words in one line, two and three, whose neighbours differ.
    for lines, n in ((1, 55), (2, 30), (3, 18)):
        own = [" ".join(f"p{lines}{j}{k}" for k in range(n)) for j in range(lines)]
        rows += [(300 + 10 * lines + i, "\n".join([line(), *own, line()])) for i in range(3)]
    rows += [(200, None), (201, ""), (202, ""), (203, "a\n\n\na"), (204, "w " * 60), (205, "w " * 60), (206, "\n" * 9), (207, "\n" * 9), (5, rows[5][1])]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, removed int, start string")
    want = brute(rows)
    out = line_dedup.remove_repeats(df)
    assert out.columns == [*df.columns, "removed_lines"]
    got = out.collect()
    assert len(got) == len(rows)
    texts = {}
    for r in got:
        texts.setdefault(r.doc_id, []).append(r.text)
    for doc, text in rows:
        assert all(t == (None if text is None else want[doc, text]) for t in texts[doc]), doc
    assert sum(len(want[d, t]) < len(t) for d, t in rows if t) > 20
    assert line_dedup.remove_repeats(df.limit(0)).count() == 0
    for lines, n in ((1, 55), (2, 30), (3, 18)):
        assert [f"p{lines}" in texts[300 + 10 * lines + i][0] for i in range(3)] == [True, False, False]


def test_hot_units_and_long_texts(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(line_dedup, "join_groups", lambda *a: join_groups(*a[:-1], 0) if a[-1] else None)
    same = "first line of all\nsecond line of all\nthird " + "w " * 60
    rows = [(i, f"own {i}\n{same}") for i in range(1500)] + [(5000, "\n".join(f"{rng.random()} b c" for _ in range(30000)))]
    got = {r.doc_id: (r.text, r.removed_lines) for r in line_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert all(got[d][0] == want[d, t] for d, t in rows) and sum(n for _, n in got.values()) > 1499


def test_clashing_names(spark):
    rows = [(1, "a b\nc d", 1, 2, 3, 4), (1, "a b\nc d", 5, 6, 7, 8), (2, "a b\nc d", 1, 2, 3, None), (None, None, 1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone int, who int, _lost int, row int")
    out = line_dedup.remove_repeats(df)
    assert out.columns == [*df.columns, "removed_lines"]
    assert sorted((r.doc_id or 0, r.text or "", r._gone, r.removed_lines) for r in out.collect()) == [(0, "", 1, 0), (1, "a b\nc d", 1, 0), (1, "a b\nc d", 5, 0), (2, "", 1, 2)]
    with pytest.raises(ValueError):
        line_dedup.remove_repeats(out)


def test_equal_hashes_are_not_equal_lines(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(line_dedup, "line_digest", lambda line: F.md5(F.substring(line, 1, 1).cast("binary")))
    df = spark.createDataFrame([(1, "one\ntwo"), (2, "other\ntree"), (3, "one\ntwo"), (4, "ax\nbx"), (5, "ax\nbx")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.remove_repeats(df).collect()}
    assert got == {1: "one\ntwo", 2: "other\ntree", 3: "one\ntwo", 4: "ax\nbx", 5: ""}


def test_a_first_place_is_compared_too(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(line_dedup, "line_digest", lambda line: F.md5(F.substring(line, 1, 1).cast("binary")))
    rows = [(1, "one\ntwo"), (2, "other\ntree"), (4, "ax\nbx"), (5, "ax\nbx")]
    got = {r.doc_id: r.text for r in line_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "one\ntwo", 2: "other\ntree", 4: "ax\nbx", 5: ""}


def test_a_passage_spread_over_blank_lines(spark):
    spread = "\n\n\n".join(f"w{i}" for i in range(51))
    few = "\n\n\n".join(f"v{i}" for i in range(50))
    texts = [f"{own}\n{passage}\n{own * 2}" for passage in (spread, few) for own in ("one ", "two ", "three ")] + ["\n" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.remove_repeats(df).collect()}
    assert got == {d: t for (d, _), t in brute(list(enumerate(texts))).items()}
    assert "w7" in got[0] and "w" not in got[1].replace("two", "") and "w50" not in got[2]

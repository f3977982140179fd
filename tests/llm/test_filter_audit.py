import random
import re
from collections import Counter
from itertools import permutations

from kindred.llm.filter_audit import FILTERS, audit, bitmap_index, failures, prefix_counts

DOCS = "doc_id long, text string, source string, part int, hash string, A string, good int"


def brute_force(docs, labels):
    first = {}
    for doc_id, text, *_ in docs:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    marks = {k: (any(q == 1 for i, q, _ in labels if i == k), any(t == 1 for i, _, t in labels if i == k)) for k, _, _ in labels if k is not None}
    rows = []
    for doc_id, text, source, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": doc_id is not None and doc_id > first[text],
        }
        rows.append((source or "", fails, *marks.get(doc_id, (False, False))))
    out = []
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        found, shapley = [], Counter()
        for order in permutations(FILTERS):
            left = own
            for step, f in enumerate(order, 1):
                removed = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                redundant = sum(r[1][f] for r in own) - len(removed)
                alone = sum(r[1][f] and sum(r[1].values()) == 1 for r in own)
                shapley[f] += len(removed)
                found.append(("".join(order), step, len(left), len(removed), redundant, alone, sum(r[2] for r in removed), sum(r[3] for r in removed)))
        out += [(part, *row, shapley[row[0][row[1] - 1]]) for row in found]
    return sorted(out)


def made():
    draw = random.Random(5)
    words = ["alpha", "Beta", "GAMMA", "a#b", "x|y", "wé", "z z"] + [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(draw.choices(words[: draw.choice([3, 60, 307])], k=draw.choice([0, 5, 199, 200, 201, 500]))), draw.choice(["s", "t", "", None]), i, "h", "A", 9) for i in range(80)]
    docs += [(100 + i, docs[i % 7][1], "t", 0, "h", "A", 9) for i in range(40)]  # copies
    docs += docs[:5]  # repeated rows
    docs += [(None, docs[0][1], "s", 0, "h", "A", 9), (None, None, None, 0, "h", "A", 9), (500, None, "only", 0, None, None, None), (501, "", "only", 0, None, None, None), (502, "\t \n", "only", 0, "", "", 0)]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, 130, 2)] + [(2, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


def test_equals_brute_force(spark):
    docs, labels = made()
    rows = audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    names = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert sorted(tuple(r[n] for n in names) for r in rows) == brute_force(docs, labels)


def test_index_of_many_parts_and_batches(spark):
    """Counts do not hang on how rows fall into batches and bitmaps."""
    docs, labels = made()
    docs = [(d[0], d[1], f"part {i % 37}", *d[3:]) for i, d in enumerate(docs)]
    rows = failures(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = spark.createDataFrame(rows.toPandas())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        index = bitmap_index(rows.repartition(3))
        assert index.selectExpr("max(n_rows)").first()[0] <= 11
        got = {tuple(r) for r in prefix_counts(index).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {tuple(r) for r in prefix_counts(bitmap_index(rows.coalesce(1))).collect()} and len(got) == 37 * 80


def test_empty(spark):
    assert audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0

import math
import zlib

import numpy as np

from kindred.llm import quality

SF = "/root/testdata/sf0.01"


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    model = quality.Model(0.3, rng.normal(size=600), rng.normal(size=(600, 4)), 8)
    place, value = np.array([3, 77, 300, 599]), rng.normal(size=4)
    z = 0.3 + sum(model.weight[i] * x for i, x in zip(place, value, strict=True))
    for i in range(4):
        for j in range(i + 1, 4):
            z += float(model.factors[place[i]] @ model.factors[place[j]]) * value[i] * value[j]
    assert abs(model.score(place, value) - 1 / (1 + np.exp(-z))) < 1e-9


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.score_documents(docs, quality.train(docs, labels)).collect()}
    assert len(got) == docs.count()
    right = [got[r.doc_id].predicted == r.quality for r in labels.collect() if got[r.doc_id].held_out]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    assert len(right) > 40 and sum(right) / len(right) > 0.93


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None, "x"), (2, "", 0, "x"), (None, "words " * 5000, 9, "x"), (1, None, None, "x")], "doc_id long, text string, n_chars long, score string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    rows = quality.score_documents(docs, quality.train(docs, labels)).collect()
    assert [r.score for r in rows] == [0.5] * 4
    one = spark.createDataFrame([(2, 1), (2, 0), (1, 1)], "doc_id long, quality int")
    model = quality.train(docs, one)
    assert all(0 <= r.score <= 1 for r in quality.score_documents(docs, model).collect())
    kept = quality.keep_documents(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == 4 and quality.keep_documents(docs, model, 1.1).count() == 0
    assert quality.score_documents(docs.drop("n_chars").limit(0), model).count() == 0


def test_a_repeated_id_is_one_training_row(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    rows = [(ids[0], f"copy {k}", 6) for k in range(300)] + [(i, f"text of {i}", 9) for i in ids[1:]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    got = quality.training_rows(docs, labels, 14, 50)
    assert len(got) == len(ids) and [y for *_, y in got] == [i % 2 for i in ids]
    assert len(quality.training_rows(docs, labels, 14, 10)) == 10


def brute_score(model, text, n_chars):
    """A document's score from its definition: features one by one, pairs one by one."""
    data = (text or "").encode()
    words, counts = data.lower().split(), {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    place = {}
    for w, c in counts.items():
        at = zlib.crc32(w) % (1 << model.bits)
        place[at] = place.get(at, 0) + c
    value = {at: 1 + math.log(c) for at, c in place.items()}
    norm = math.sqrt(sum(v * v for v in value.values())) or 1
    x = {at: v / norm for at, v in value.items()}
    n, k = max(1, len(data)), max(1, len(words))
    kind = lambda f: sum(map(f, data))
    lower, upper, digit = kind(lambda b: 97 <= b < 123), kind(lambda b: 65 <= b < 91), kind(lambda b: 48 <= b < 58)
    blank, line, beyond = kind(lambda b: b in b" \t\x0b\x0c\r"), data.count(10), kind(lambda b: b >= 128)
    marks = [b for b in data if b < 128 and not chr(b).isalnum() and b not in b" \t\x0b\x0c\r\n"]
    top = max((marks.count(b) for b in set(marks)), default=0)
    lines = data.split(b"\n")
    stats = [
        math.log1p(len(words)) / 14, math.log1p(len(data)) / 20, min(1, len(data) / k / 16), upper / max(1, upper + lower), min(1, 4 * digit / n), min(1, 3 * blank / n),
        min(1, 20 * line / n), min(1, 3 * len(marks) / n), min(1, len(marks) / k / 4), top / max(1, len(marks)), beyond / n, len(counts) / k, len(set(lines)) / len(lines),
        0 if n_chars is None else min(1, (1 + math.log1p(max(0, n_chars))) / 20),
    ]
    for i, v in enumerate(stats):
        x[(1 << model.bits) + 16 * i + min(15, int(v * 16))] = 0.5
    at = sorted(x)
    z = model.bias + sum(model.weight[i] * x[i] for i in at)
    z += sum(float(model.factors[i] @ model.factors[j]) * x[i] * x[j] for a, i in enumerate(at) for j in at[a + 1 :])
    return 1 / (1 + math.exp(-z))


def test_scores_as_brute_force(spark):
    rng = np.random.default_rng(4)
    size = (1 << 8) + quality.BINS * quality.STATISTICS
    model = quality.Model(-0.2, rng.normal(size=size), rng.normal(0, 0.3, (size, 3)), 8)
    texts = [None, "", "One two, two!\nTHREE 3 three\n", "é ü ß " * 9, "--- ### \t\r\n 12345", "a" * 50, "\n\n\n", " ".join(f"w{i % 40}" for i in range(300))]
    rows = [(i, t, None if i % 3 == 0 else 17 * i, "de", "s") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, lang string, source string")
    got = {r.doc_id: r.score for r in quality.score_documents(docs, model).collect()}
    assert all(abs(got[i] - brute_score(model, t, n)) < 1e-9 for i, t, n, *_ in rows)
    kept = {r.doc_id for r in quality.keep_documents(docs, model, 0.5).collect()}
    assert kept == {i for i, s in got.items() if s >= 0.5}

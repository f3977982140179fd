import math
import random
import re
from collections import Counter

import pytest

from kindred.llm import lm_score

LABELS = "doc_id long, quality int, toxic int"


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]


def models(texts, target, top):
    """Both models' chances of a word behind another (None: at the start), with plain dictionaries."""
    lists = [tokens(t) for t in texts]
    n = Counter(w for x in lists for w in x)
    frequent = set(sorted(n, key=lambda w: (-n[w], w))[:top])
    of = lambda w: w if w is None or w in frequent else "*"

    def model(own):
        count = Counter(w for x in own for w in x)
        pair = Counter((of(v), of(w)) for x in own for v, w in zip([None, *x], x, strict=False))
        share = len(count) / len(n)
        single = {w: (count[w] + share) / (count.total() + len(count)) for w in n}

        def chance(v, w):
            alike = [x for x in n if of(x) == of(w)]
            total = sum(c for p, c in pair.items() if p[0] == of(v))
            kinds = sum(p[0] == of(v) for p in pair)
            of_class = sum(single[x] for x in alike)
            behind = (pair[of(v), of(w)] + kinds * of_class) / (total + kinds) if total else of_class
            return behind * single[w] / of_class

        return chance

    return sorted(n), model(lists), model([x for x, use in zip(lists, target, strict=True) if use])


def brute(texts, target, top):
    """Scores of texts by the formulas."""
    _, background, good = models(texts, target, top)
    out = []
    for x in map(tokens, texts):
        d = [math.log2(good(v, w)) - math.log2(background(v, w)) for v, w in zip([None, *x], x, strict=False)]
        out.append(sum(d) / len(d) if d else 0.0)
    return out


def test_brute_force_models_add_up_to_one():
    texts = ["a b c a b", "c c d e f", "a a a"]
    for top in (1, 3, 10):
        words, *both = models(texts, [True, False, True], top)
        for chance in both:
            for v in [None, *words]:
                assert sum(chance(v, w) for w in words) == pytest.approx(1)


@pytest.mark.parametrize(("top", "pairs"), [(1000, 1000), (6, 9), (3, 0), (1000, 0)])
def test_as_brute_force(spark, top, pairs):
    rng = random.Random(2)
    words = ["The", "the", "cat", "Äpfel", "in", "1914", "2026", "日本", "rare", "x,", "y."]
    texts = [" ".join(rng.choices(words, weights=range(11, 0, -1), k=rng.randint(1, 30))) for _ in range(60)] + [None, "", " \n\t ", "once only", " \r\n the  cat\tin "]
    rows = [(i, t, "clash", 1, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "clash", 1, "clash"), (None, "the cat", "clash", 1, "clash")]
    labels = [(i, 1, 0) for i in range(0, 30)] + [(31, 1, 1), (32, 0, 0), (5, 0, 0), (None, 1, 0), (33, None, 0), (34, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n int, good string")
    found = lm_score.score_documents(docs, spark.createDataFrame(labels, LABELS), top, pairs)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.score) for r in found.collect())
    good = [d is not None and d < 30 and d != 5 for d, *_ in rows]
    want = brute([r[1] for r in rows], good, top)
    assert got == sorted((d is not None, d or 0, len(tokens(t)), pytest.approx(s, abs=3e-6)) for (d, t, *_), s in zip(rows, want, strict=True))


def test_a_seen_pair_is_measured_by_all_that_stands_behind_its_word(spark):
    # One pair of "a" is frequent; the many others behind it must weigh in its chance, kept in a broadcast or not.
    rows = [(i, f"a x{i}") for i in range(300)] + [(1000 + i, "a b") for i in range(8)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, 1, 0) for i in range(150)], LABELS)
    want = brute([t for _, t in rows], [d < 150 for d, _ in rows], 1 << 16)
    for pairs in (0, 1, 1 << 20):
        got = {r.doc_id: r.score for r in lm_score.score_documents(docs, labels, pairs=pairs).collect()}
        assert [got[d] for d, _ in rows] == pytest.approx(want, abs=3e-6)


def test_numbers_scripts_and_words_tell(spark):
    docs = spark.createDataFrame([(1, "born in 1914 " * 20), (2, "born in 2026 " * 20), (3, "日本 語"), (4, "日本 人"), (5, "日本 語")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_score.score_documents(docs, spark.createDataFrame([(1, 1, 0), (5, 1, 0)], LABELS)).collect()}
    assert got[1] > got[2] and got[3] > got[4] and got[3] == got[5]


def test_long_texts_and_no_target(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c " * 300_000), (2, "x y x y")], "doc_id long, text string")
    empty = spark.createDataFrame([], LABELS)
    assert [(r.n_tokens, r.score) for r in lm_score.score_documents(docs, empty).orderBy("doc_id").collect()] == [(900_000, 0), (4, 0)]
    good = spark.createDataFrame([(2, 1, 0)], LABELS)
    assert [r.score > 0 for r in lm_score.score_documents(docs, good).orderBy("doc_id").collect()] == [False, True]
    assert lm_score.score_documents(docs.limit(0), good).count() == 0
    monkeypatch.setattr(lm_score, "IDS", 0)
    assert [r.score > 0 for r in lm_score.score_documents(docs, good).orderBy("doc_id").collect()] == [False, True]


def test_the_model_grows_with_the_corpus(spark):
    rng = random.Random(1)
    for n in (40, 400):
        rows = [(i, " ".join(f"w{rng.randint(0, n)}" for _ in range(50))) for i in range(n)]
        docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, 1, 0)], LABELS)
        model = lm_score.train(lm_score._rows(docs, labels), top=20, pairs=10)
        assert model.vocabulary.count() == len({w for _, t in rows for w in t.split()})
        met = {p for _, t in rows for p in zip(["", *t.split()], t.split(), strict=False)}
        assert len(model.codes) <= 10 < model.others.count() <= model.pairs.count() <= len(met)
        whole = lm_score.train(lm_score._rows(docs, labels))
        assert whole.pairs.count() == len(met)

import random

from pyspark.sql import functions as F

from kindred.functions.text import enrich
from kindred.operators.blocking import candidate_pairs, key_index
from kindred.operators.neighbours import neighbour_pairs
from kindred.operators.qgrams import head_keys, qgram_pairs, qgrams, similar_names

SCHEMA = "entity_id string, business_name string, business_address string, country string"


def records(spark, prefix, n, seed):
    draw = random.Random(seed)
    words = ["north", "nord", "light", "lights", "works", "work", "stone", "é lan", "k", ""]
    rows = [(f"{prefix}-{i}", " ".join(draw.choices(words, k=draw.choice([0, 1, 2, 2, 3]))), "1 High Road", draw.choice(["Peru", "Chile", None])) for i in range(n)]
    rows += [(f"{prefix}-{n + i}", "same name", "", "Peru") for i in range(25)]
    return enrich(spark.createDataFrame(rows, SCHEMA)).cache()


def test_neighbours_equal_brute_force(spark):
    a, b = records(spark, "S1", 60, 1), records(spark, "S2", 90, 2)
    rows = [(r.country_normalized, r.business_name_core.encode(), s, r.entity_id) for s, df in ((1, a), (2, b)) for r in df.collect()]
    rows.sort()
    for window, block in ((2, 2), (5, 7), (9, 1000)):
        want = set()
        for i, x in enumerate(rows):
            for y in rows[i + 1 : i + window]:
                if x[0] == y[0] and x[2] != y[2]:
                    want.add((x[3], y[3]) if x[2] == 1 else (y[3], x[3]))
        got = [tuple(r) for r in neighbour_pairs(a, b, window, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert neighbour_pairs(a.limit(0), b, 4).count() == 0


def test_qgrams_equal_brute_force(spark):
    a, b = records(spark, "S1", 60, 3), records(spark, "S2", 90, 4)
    grams = lambda s, q: {s[i : i + q] for i in range(max(1, len(s) - q + 1))} if s else set()
    left, right = ([(r.entity_id, r.country_normalized, r.business_name_normalized) for r in df.collect()] for df in (a, b))
    for least, q in ((0.6, 3), (0.25, 2), (1.0, 4)):
        want = set()
        for i, c, x in left:
            for j, d, y in right:
                g, h = grams(x, q), grams(y, q)
                if c == d and g and h and len(g & h) / len(g | h) >= least:
                    want.add((i, j))
        got = [tuple(r) for r in qgram_pairs(a, b, least, q).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
    names = a.select(F.col("country_normalized").alias("country"), F.col("business_name_normalized").alias("name"))
    assert similar_names(names, names, 1.0).filter("left_name <> right_name and similarity < 1").count() == 0


def test_qgrams_that_meet_are_few(spark):
    """Random names that share single q-grams only are not brought together; short names of one q-gram are."""
    draw = random.Random(7)
    names = [("Peru", "".join(draw.choices("abcdefgh", k=14))) for _ in range(1500)] + [("Peru", "ab"), ("Peru", "abc"), ("Peru", "abcd")]
    table = spark.createDataFrame(names, "country string, name string")
    keys = table.withColumn("ids", F.transform(qgrams(F.col("name"), 3), lambda g: F.xxhash64(g))).withColumn("size", F.size("ids")).withColumn("shared", F.ceil(F.col("size") * 0.6).cast("int"))
    once = keys.select("name", F.explode(head_keys()).alias("key"))
    by_one = keys.select("name", F.explode(F.slice("ids", F.lit(1), F.col("size") - F.col("shared") + 1)).alias("key"))
    assert once.join(once.withColumnRenamed("name", "other"), "key").count() < by_one.join(by_one.withColumnRenamed("name", "other"), "key").count() / 2
    got = {(r.left_name, r.right_name) for r in similar_names(table, table, 0.6, 3).collect()}
    grams = lambda s: {s[i : i + 3] for i in range(max(1, len(s) - 2))}
    sets = [(n, grams(n)) for _, n in names]
    assert got == {(x, y) for x, g in sets for y, h in sets if len(g & h) / len(g | h) >= 0.6}
    assert got >= {("ab", "ab"), ("abc", "abc")}


def test_each_source_is_normalised_once(spark):
    """What is counted, cut and joined reads stored keys: no plan folds text, and an index serves several targets."""
    plain = lambda prefix: spark.createDataFrame([(f"{prefix}-{i}", f"name {i % 7} é", "5 Low Road", "Peru") for i in range(40)], SCHEMA)
    index, other = key_index(plain("S1")), plain("S2")
    pairs = candidate_pairs(index, other)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEval" not in plan and "PythonUDF" not in plan
    assert {tuple(r) for r in pairs.collect()} == {tuple(r) for r in candidate_pairs(plain("S1"), other).collect()}
    assert key_index(index) is index

import itertools
import json

import pytest
from pyspark.sql import functions as F

from kindred.functions import text as fn
from kindred.functions.constants import ADDRESS_NOISE, FEATURES, NAME_NOISE
from kindred.operators import evaluate, matching, model, threshold, training, validate
from kindred.operators.blocking import address_word_counts, candidate_pairs
from kindred.operators.features import pair_features
from kindred.plans.linkage import match_by_rule, train_and_match
from kindred.sources import testrecords, tsv

SF = "/root/testdata/sf0.001"
ROWS = [
    ("S1-1", "Quartz Valley Bakers Ltd", "18 Orchard Ave, Salem, OR 97301", "US"),
    ("S1-2", "Nandini Textiles Private Limited", "7 Temple Road, Mysore - 570004", "India"),
    ("S1-3", "Café Étoile SAS", "3 Quai Nord, 69002 Lyon", "France"),
    ("S2-101", "Quartz Valley Bakers", "18 Orchard Avenue, Salem, OR 97301", "US"),
    ("S2-102", "Nandini Textiles", "7 Temple Rd, Mysuru 570004", "India"),
    ("S2-103", "Cafe Etoile", "3 Quai Nord, Lyon 69002", "France"),
    ("S2-104", "Blue Heron Shipping", "55 Dock Lane, Hull", "UK"),
]
COLUMNS = "entity_id string, business_name string, business_address string, country string"


@pytest.fixture(scope="module")
def fixture(spark):
    return spark.createDataFrame(ROWS[:3], COLUMNS), spark.createDataFrame(ROWS[3:], COLUMNS)


def test_three_pairs(fixture):
    s1, s2 = fixture
    pairs = candidate_pairs(s1, s2)
    assert sorted(map(tuple, pairs.collect())) == [("S1-1", "S2-101"), ("S1-2", "S2-102"), ("S1-3", "S2-103")]
    rows = pair_features(pairs, s1, s2).collect()
    assert len(rows) == 3
    assert all(r.country_match == 1 and r.postal_code_match == 1 for r in rows)
    assert all(0 <= r[c] <= 1 for r in rows for c in FEATURES)


def brute_pairs(a_rows, b_rows, max_df=100):
    web = lambda t: next((t[: -len(e)] for e in (".com", ".in", ".org", ".net", ".co", ".io", ".biz", ".info") if t.endswith(e) and len(t) > len(e)), t)

    def names(r):
        words = [t for t in r.business_name_tokens if t not in NAME_NOISE]
        keys = {web(t) for t in r.business_name_tokens}
        keys = {k for k in keys if len(k) >= 3 and k not in NAME_NOISE}
        run = "".join(map(web, words))
        return keys | ({run} if len(run) >= 4 else set())

    df = {}
    for b in b_rows:
        for w in set(b.address_tokens):
            df[b.country_normalized, w] = df.get((b.country_normalized, w), 0) + 1
    out = set()
    for a, b in itertools.product(a_rows, b_rows):
        if a.country_normalized != b.country_normalized:
            continue
        numbers = set(a.address_numbers) & set(b.address_numbers)
        words = set(a.address_tokens) & set(b.address_tokens)
        rare = {w for w in words if len(w) >= 4 and w not in ADDRESS_NOISE and df[b.country_normalized, w] <= max_df}
        hit = bool(names(a) & names(b)) or (a.business_name_core == b.business_name_core and len(a.business_name_core) >= 3)
        hit |= bool(a.postal_code) and a.postal_code.lower() == b.postal_code.lower() and (bool(numbers) or len(words) >= 2)
        first = a.address_numbers[:1] and a.address_numbers[:1] == b.address_numbers[:1]
        hit |= bool(first) and (bool(set(a.business_name_tokens) & set(b.business_name_tokens)) or len(words) >= 2)
        hit |= len(rare) >= 2 or bool(rare and numbers)
        if hit:
            out.add((a.entity_id, b.entity_id))
    return out


@pytest.mark.parametrize("max_df", [100, 3])
def test_blocking_as_brute_force(spark, max_df):
    s1, s2 = (fn.enrich(testrecords.records(spark, SF, s)) for s in ("s1", "s2"))
    got = set(map(tuple, candidate_pairs(s1, s2, max_df=max_df).collect()))
    assert got == brute_pairs(s1.collect(), s2.collect(), max_df)


def test_hot_keys_are_cut_and_lose_nothing(spark):
    rows = lambda mark, n: spark.createDataFrame([(f"{mark}-{i}", f"common word{i % 9}", f"{i % 4} Long Meadow, X", "US") for i in range(n)], COLUMNS)
    s1, s2 = rows("S1", 60), rows("S2", 90)
    want = set(map(tuple, candidate_pairs(s1, s2).collect()))
    assert len(want) == 60 * 90
    assert set(map(tuple, candidate_pairs(s1, s2, hot=7).collect())) == want


def test_parts_of_a_target_give_the_pairs_of_the_whole(spark):
    s1, s2 = (fn.enrich(testrecords.records(spark, SF, s)) for s in ("s1", "s2"))
    counts = address_word_counts(s2)
    parts = [candidate_pairs(s1, s2.filter(F.expr(f"pmod(hash(entity_id), 3) = {i}")), max_df=5, address_counts=counts) for i in range(3)]
    whole = candidate_pairs(s1, s2, max_df=5)
    assert set(map(tuple, parts[0].union(parts[1]).union(parts[2]).collect())) == set(map(tuple, whole.collect()))


def test_required_columns(spark):
    df = spark.createDataFrame([("a", 1)], "source1_entity_id string, label int")
    with pytest.raises(ValueError, match="name_jaro_winkler"):
        model.train(df)
    with pytest.raises(ValueError, match="training pairs: no column target_entity_id, source"):
        training.training_features(df, df, {})


def test_audit_files(spark, tmp_path):
    s2 = fn.enrich(testrecords.records(spark, SF, "s2"))
    evaluate.write_audit(s2, str(tmp_path / "a"), 50)
    assert spark.read.json(str(tmp_path / "a/audit")).first().n_records == s2.count()
    sample = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "a/sample"))
    assert sample.count() == 50 and sample.columns == s2.columns


def test_entity_scores(spark):
    truth = spark.createDataFrame([("S1-1", "S2-00047"), ("S1-1", "S3-00812"), ("S1-3", "S2-1"), ("S1-4", "S2-2")], "source1_entity_id string, target_entity_id string")
    said = spark.createDataFrame([("S1-1", "S2-00047"), ("S1-1", "S2-00193"), ("S1-1", "S3-00812"), ("S1-4", "S2-9"), ("S1-5", "S2-8")], "source1_entity_id string, target_entity_id string")
    ids = spark.createDataFrame([(f"S1-{i}",) for i in range(1, 6)], "entity_id string")
    got = {r.source1_entity_id: (r.precision, r.recall, r.f05) for r in threshold.entity_f05(said, truth, ids).collect()}
    assert got["S1-1"] == (pytest.approx(2 / 3), 1.0, pytest.approx(0.714, abs=5e-4))
    assert got["S1-2"] == (1, 1, 1)
    assert got["S1-3"] == got["S1-4"] == got["S1-5"] == (0, 0, 0)


def test_threshold_ties_go_to_the_higher(spark):
    scored = spark.createDataFrame([("S1-1", "S2-1", 0.9), ("S1-2", "S2-2", 0.2), ("S1-2", "S2-2", 0.1)], "source1_entity_id string, target_entity_id string, prediction_probability double")
    truth = spark.createDataFrame([("S1-1", "S2-1")], "source1_entity_id string, target_entity_id string")
    table = threshold.sweep(scored, truth)
    assert table.count() == 86
    assert threshold.best(table).first().threshold == 0.9
    assert tsv.best_in_table(table) == 0.21
    by = {r.threshold: r.macro_f05 for r in threshold.sweep(scored, truth, "all", spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "source1_entity_id string")).collect()}
    assert by[0.5] == 1.0 and by[0.95] == pytest.approx(2 / 3)


def test_result_file_checks(spark, tmp_path):
    path = str(tmp_path / "r.tsv")
    lines = ["source1_entity_id\tmatched_entity_ids", "S1-1\tS2-1,S2-1", "S1-1\tS3-4", "S1-2 S2-2", "S1-3\tS1-9,X1-1,S2-77", "S1-8\t", ""]
    with open(path, "w") as f:
        f.write("\n".join(lines))
    result = validate.read_result(spark, path, "matched_entity_ids")
    need = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "id string")
    known = spark.createDataFrame([("S2-1",), ("S3-4",)], "id string")
    offered = spark.createDataFrame([("S1-1", "S2-1,S3-4")], "source1_entity_id string, candidate_entity_ids string")
    got = {r.issue: r.n for r in validate.issues(result, need, known, offered).collect()}
    assert got == {
        "malformed row": 1, "duplicate entity": 1, "duplicate id in list": 1, "match within source 1": 1, "wrong prefix": 1, "missing entity": 1,
        "extra entity": 1, "empty list": 1, "unknown id": 3, "match is no candidate": 3,
    }
    with pytest.raises(ValueError):
        validate.read_result(spark, path, "candidate_entity_ids")


def test_every_part_of_a_result_begins_with_its_header(spark, tmp_path):
    head = "source1_entity_id\tmatched_entity_ids"
    out = tmp_path / "parts"
    lines = [(f"S1-{i}\t",) if i % 3 else (f"  S1-{i} 'S2-\"{i}\" ",) for i in range(40)]
    tsv.write_lines(spark.createDataFrame(lines, "value string").repartition(4), head, str(out))
    parts = [p.read_text().splitlines() for p in sorted(out.glob("part-*"))]
    assert len(parts) == 4 and all(p[0] == head for p in parts)
    assert sorted(x for p in parts for x in p[1:]) == sorted(x for x, in lines)
    assert validate.read_result(spark, str(out), "matched_entity_ids").count() == 40
    (out / "part-9.csv").write_text("S1-99\tS2-99\n")
    with pytest.raises(ValueError, match="S1-99.*part-9"):
        validate.read_result(spark, str(out), "matched_entity_ids")
    tsv.write_lines(spark.createDataFrame([], "value string"), head, str(out / "none"))
    assert validate.read_result(spark, str(out / "none"), "matched_entity_ids").count() == 0


def test_result_files_are_written_and_checked(spark):
    from kindred.plans import queries

    n = spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").collect()
    broken = sum(r.c_custkey % 20 == 3 for r in n)
    offered = sum(r.c_custkey % 3 != 0 and r.c_custkey % 20 != 3 for r in n)
    got = {r.issue: r.n for r in queries.validate_files(spark, SF).collect()}
    assert {k: v for k, v in got.items() if v} == {
        "malformed row": broken, "missing entity": broken, "match is no candidate": offered,
        "empty list": sum(r.c_custkey % 10 == 9 and r.c_custkey % 3 == 0 and r.c_custkey % 20 != 3 for r in n),
    }


def test_tsv_round_trip(spark, tmp_path):
    path = str(tmp_path / "in.tsv")
    with open(path, "w", encoding="utf-8") as f:
        f.write('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tNA\t\t null \nS1-2\t"say ""hi"""\tnull\tFR\n')
    got = sorted(map(tuple, tsv.read_records(spark, path).collect()))
    assert got == [("S1-1", "NA", "", " null "), ("S1-2", 'say "hi"', "null", "FR")]
    assert {r.entity_id for r in tsv.read_id_set(spark, path).collect()} == {"S1-1", "S1-2"}
    assert tsv.with_ids(tsv.read_records(spark, path), spark.createDataFrame([("S1-2",), ("S1-2",)], "x string")).count() == 1
    out = str(tmp_path / "out")
    tsv.write_tsv(matching.lists(spark.createDataFrame([("S1-1",), ("S1-2",)], "e string"), spark.createDataFrame([("S1-1", "S3-2"), ("S1-1", "S2-3"), ("S1-1", "S2-3")], "source1_entity_id string, target_entity_id string")).coalesce(1), out)
    text = spark.read.text(out).collect()
    assert sorted(r.value for r in text) == ["S1-1\tS2-3,S3-2", "S1-2\t", "source1_entity_id\tmatched_entity_ids"]
    meta = str(tmp_path / "t.json")
    assert tsv.read_threshold(spark, meta) == 0.78
    tsv.write_threshold(spark, meta, {"threshold": 0.61, "macro_f05": 0.9})
    assert tsv.read_threshold(spark, meta) == 0.61 and json.loads(spark.read.text(meta, wholetext=True).first().value)["macro_f05"] == 0.9


def test_training_sets(spark):
    pairs = spark.createDataFrame([("a", f"t{i:02}", int(i < 3)) for i in range(40)] + [("b", "x", 0)], "source1_entity_id string, target_entity_id string, label int")
    kept = training.cap_negatives(pairs, 20)
    assert kept.filter("label = 1").count() == 3 and kept.filter("source1_entity_id = 'a' and label = 0").count() == 20
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, training.cap_negatives(pairs.repartition(3), 20).collect()))
    split = training.grouped_split(spark.range(1000).select(F.col("id").cast("string").alias("source1_entity_id")))
    assert 120 < split.filter("is_validation").count() < 280
    assert split.groupBy("source1_entity_id").agg(F.countDistinct("is_validation").alias("n")).filter("n > 1").count() == 0


def test_train_and_match_finds_the_truth(spark, tmp_path):
    s1, s2 = (testrecords.records(spark, SF, s) for s in ("s1", "s2"))
    truth = tsv.truth_pairs(testrecords.truth(spark, SF)).filter("target_entity_id like 'S2%'")
    scored, best, fitted = train_and_match(s1, {"S2": s2}, truth, str(tmp_path / "model"), trees=10, rate=0.1, min_rows=5)
    assert best["macro_f05"] > 0.9
    said = matching.accepted(scored, best["threshold"])
    assert threshold.macro(threshold.entity_f05(said, truth, s1.select("entity_id"))).first().macro_f05 > 0.85
    assert len(model.importances(fitted)) == 12
    about = model.load_metadata(str(tmp_path / "model"))
    assert about["features"] == FEATURES and about["metrics"] == best and about["parameters"]["min_rows"] == 5
    again = model.load(str(tmp_path / "model"))
    features = pair_features(candidate_pairs(s1, s2), s1, s2)
    assert model.score(again, features).count() == features.count()


def test_features_are_made_once_for_fitting_and_scoring(spark, monkeypatch):
    from kindred.operators import blocking
    from kindred.plans import linkage

    calls = []
    for place in (linkage, training):
        monkeypatch.setattr(place, "pair_features", lambda *a, own=place.pair_features: calls.append("features") or own(*a))
    monkeypatch.setattr(blocking, "keyed", lambda *a, own=blocking.keyed: calls.append("keys") or own(*a))
    s1, s2, s3 = (testrecords.records(spark, SF, s) for s in ("s1", "s2", "s3"))
    truth = tsv.truth_pairs(testrecords.truth(spark, SF))
    scored, best, _ = train_and_match(s1, {"S2": s2, "S3": s3}, truth, trees=2, rate=0.1, min_rows=5)
    assert calls.count("features") == 2 and calls.count("keys") == 3
    got = sorted((r.target_source, r.source1_entity_id, r.target_entity_id) for r in scored.collect())
    want = sorted((n, *p) for n, t in (("S2", s2), ("S3", s3)) for p in candidate_pairs(s1, t).collect())
    assert got == want and best["macro_f05"] > 0.8


def test_equal_training_rows_are_fitted_as_weights(spark, monkeypatch):
    monkeypatch.setattr(model, "PIECES", 50)
    x = (F.col("id") % 20 >= 10).cast("double")
    rows = spark.range(4000).select(*[(x if c == FEATURES[0] else F.lit(0.5)).alias(c) for c in FEATURES], (x + (F.col("id") % 7 == 0).cast("int") > 0).cast("int").alias("label"), (F.col("id") % 5 == 4).alias("is_validation"))
    kept, total = model.weighted(model.numeric(rows))
    held = kept.groupBy("is_validation").agg(F.sum("times"), F.count(F.lit(1)), F.max("times")).orderBy("is_validation").collect()
    assert total == 3200 and [r[1] for r in held] == [3200.0, 800.0] and held[0][2] <= 50 + 4 and held[0][3] <= 3200 / 50
    grown = lambda n: model.train(rows, trees=1, depth=1, rate=0.1, min_rows=n, row_share=1.0, feature_share=1.0).stages[-1].trees[0].numNodes
    # One split has 1,600 rows on each side.
    assert grown(100) == 3 and grown(1500) == 3 and grown(1700) == 1


def test_matches_are_candidates_and_one_row_an_entity(spark):
    s1, s2, s3 = (testrecords.records(spark, SF, s) for s in ("s1", "s2", "s3"))
    out = match_by_rule(s1, {"S2": s2, "S3": s3}, 0.5).collect()
    assert len(out) == s1.count() == len({r.source1_entity_id for r in out})
    pairs = {(r.source1_entity_id, t) for r in out for t in r.matched_entity_ids.split(",") if t}
    offered = set(map(tuple, candidate_pairs(s1, s2).union(candidate_pairs(s1, s3)).collect()))
    assert pairs and pairs <= offered
    truth = set(map(tuple, tsv.truth_pairs(testrecords.truth(spark, SF)).collect()))
    assert len(pairs & truth) / len(pairs) > 0.9


def test_metrics_of_ranking(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1), (1, 0.05)], "label int, prediction_probability double")
    assert model.roc_auc(df).first().auc == pytest.approx((2 + 1.5 + 0) / 6)
    assert model.average_precision(df).first().average_precision == pytest.approx((1 + 2 / 3 + 3 / 5) / 3)


def test_recall_and_profiles(spark, fixture):
    s1, s2 = fixture
    truth = spark.createDataFrame([("S1-1", "S2-101"), ("S1-2", "S2-104")], "source1_entity_id string, target_entity_id string")
    row = evaluate.blocking_recall(candidate_pairs(s1, s2), truth, s1).first()
    assert (row.n_truth, row.n_found, row.recall, row.n_candidates, row.candidates_per_entity) == (2, 1, 0.5, 3, 1.0)
    assert [r.target_name for r in evaluate.missed_report(candidate_pairs(s1, s2), truth, s1, s2).collect()] == ["Blue Heron Shipping"]


def test_stream(spark, tmp_path):
    from kindred.streaming.incremental import match_stream

    s1, s2 = (testrecords.records(spark, SF, s) for s in ("s1", "s2"))
    s2.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(s2.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    match_stream(s1, stream, str(tmp_path / "out"), str(tmp_path / "ck"), 0.5).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() > 50


def test_records_are_made_by_many_tasks_and_once(spark):
    """A table of one row group does not make one task of all that is computed from it, and nothing is normalised twice."""
    from kindred.plans import queries
    from kindred.sources import testrecords

    d = "/root/testdata/sf0.001"
    assert all(testrecords.records(spark, d, s).rdd.getNumPartitions() >= 4 for s in ("s1", "s2", "s3"))
    (own,) = queries._records(spark, d, "s2")
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEval" not in plan and "md5" not in plan and own.count() > 100

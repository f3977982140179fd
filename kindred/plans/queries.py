"""One query for each operator of the engine over the test tables, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import similarity as sim
from kindred.functions import text as fn
from kindred.functions.constants import DERIVED, FEATURES, RECORD
from kindred.functions.postal import postal_code
from kindred.operators import blocking, boosting, evaluate, matching, model, neighbours, qgrams, threshold, training, validate
from kindred.operators.features import pair_features
from kindred.plans import sql
from kindred.plans.linkage import match_by_rule, rule_predictions, train_and_match
from kindred.sources import testrecords, tsv
from kindred.sources.scratch import scratch_path, written
from kindred.sources.tsv import truth_pairs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
LEAST = 0.5


def query(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _records(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    """Enriched records; written, as keys, rules, features and reports each read them."""
    return [written(fn.enrich(testrecords.records(spark, d, n)), n) for n in names]


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """Source 1, the targets by name, and the targets as one table; all enriched."""
    s1, s2, s3 = _records(spark, d, "s1", "s2", "s3")
    return s1, {"S2": s2, "S3": s3}, s2.unionByName(s3)


def _truth(spark: SparkSession, d: str) -> DataFrame:
    return truth_pairs(testrecords.truth(spark, d))


# Normalisation ------------------------------------------------------------------------------------

@query(f"SELECT doc_id, {sql.text('text')} AS normalized FROM documents")
def norm_text(spark, d):
    return _table(spark, d, "documents").select("doc_id", fn.normalize_text(F.col("text")).alias("normalized"))


@query(f"SELECT doc_id, {sql.name(sql.text('text'))} AS name FROM documents")
def norm_name(spark, d):
    return _table(spark, d, "documents").select("doc_id", fn.normalize_business_name(F.col("text")).alias("name"))


@query(f"SELECT doc_id, len(t) AS n_tokens, t[1] AS first_token, t[len(t)] AS last_token FROM (SELECT doc_id, {sql.tokens(sql.name(sql.text('text')))} AS t FROM documents)")
def name_tokens(spark, d):
    tokens = fn.name_tokens(F.col("name"))
    rows = norm_name(spark, d).select("doc_id", tokens.alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.get("t", F.lit(0)).alias("first_token"), F.try_element_at("t", F.lit(-1)).alias("last_token"))


def _column_query(name: str, columns: list[str], sources=("s1", "s2", "s3")) -> None:
    listed = ", ".join(f"array_to_string({c}, ' ') AS {c}" if c in ("business_name_tokens", "address_tokens", "address_numbers") else c for c in columns)
    union = " UNION ALL ".join(f"SELECT entity_id, {listed} FROM {s}_e" for s in sources)

    def run(spark, d):
        out = None
        for s in sources:
            df = fn.enrich(testrecords.records(spark, d, s))
            own = df.select("entity_id", *[F.array_join(c, " ").alias(c) if c in ("business_name_tokens", "address_tokens", "address_numbers") else F.col(c) for c in columns])
            out = own if out is None else out.unionByName(own)
        return out

    run.__name__ = name
    query(sql.over(union, *sources))(run)


_column_query("core_name", ["business_name_normalized", "business_name_core", "business_name_tokens"])
_column_query("norm_address", ["business_address_normalized"])
_column_query("address_tokens", ["address_tokens"])
_column_query("address_numbers", ["address_numbers"])
_column_query("postal_code", ["postal_code"])


@query(testrecords.with_base(testrecords.SHAPED_CODES))
def postal_shapes(spark, d):
    """Codes of every rule, and numbers that each of the refusals holds back."""
    rows = testrecords.shaped_addresses(spark, d)
    return rows.select("k", "business_address", postal_code(F.col("business_address")).alias("postal_code"))


_column_query("norm_country", ["country_normalized"])
_column_query("enrich", DERIVED)


@query(f"SELECT page_id, {sql.web(chr(39).join(['regexp_extract(url, ', '^[a-z]+://([^/]+)', ', 1)']))} AS host FROM pages")
def strip_domain(spark, d):
    return _table(spark, d, "pages").select("page_id", fn.strip_web_domain(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)).alias("host"))


# Blocking -----------------------------------------------------------------------------------------

_ALL = "SELECT *, 'S2' AS target_source FROM p2 UNION ALL SELECT *, 'S3' FROM p3"


def _block_query(name: str, passes: tuple[str, ...]) -> None:
    def run(spark, d):
        s1, targets, _ = _both(spark, d)
        return blocking.all_candidates(s1, targets, passes=passes)

    run.__name__ = name
    query(sql.over(_ALL, "s1", "s2", "s3", more=[*sql.pairs("s2", passes, "p2"), *sql.pairs("s3", passes, "p3")]))(run)


_block_query("block_token_concat", ("token",))
_block_query("block_core", ("core",))
_block_query("block_postal", ("postal",))
_block_query("block_number", ("number",))
_block_query("block_rare_addr", ("address",))

_BOTH = [*sql.pairs("s2", blocking.PASSES, "p2"), *sql.pairs("s3", blocking.PASSES, "p3")]
_TARGETS = "t_e AS (SELECT * FROM s2_e UNION ALL SELECT * FROM s3_e)"
_PAIRS = [*_BOTH, "pa AS (SELECT * FROM p2 UNION ALL SELECT * FROM p3)", _TARGETS]
_SOURCES = ("s1", "s2", "s3")


@query(sql.over(_ALL, "s1", "s2", "s3", more=_BOTH))
def block_all(spark, d):
    s1, s2, s3 = _records(spark, d, "s1", "s2", "s3")
    return blocking.all_candidates(s1, {"S2": s2, "S3": s3})


# Similarities and features: over all true pairs; in S3 names have their words in another order ------

_TRUE = "SELECT t.source1_entity_id, t.target_entity_id, x.business_name_normalized AS a, y.business_name_normalized AS b, x.business_name_core AS ac, y.business_name_core AS bc, x.business_name_tokens AS ta, y.business_name_tokens AS tb FROM truth_e t JOIN s1_e x ON x.entity_id = t.source1_entity_id JOIN t_e y ON y.entity_id = t.target_entity_id"


def _sim_query(name: str, expression: str, column) -> None:
    def run(spark, d):
        s1, _, targets = _both(spark, d)
        left = s1.select(F.col("entity_id").alias("source1_entity_id"), *[F.col(f"business_name_{c}").alias(n) for c, n in (("normalized", "a"), ("core", "ac"), ("tokens", "ta"))])
        right = targets.select(F.col("entity_id").alias("target_entity_id"), *[F.col(f"business_name_{c}").alias(n) for c, n in (("normalized", "b"), ("core", "bc"), ("tokens", "tb"))])
        pairs = _truth(spark, d).join(left, "source1_entity_id").join(right, "target_entity_id")
        return pairs.select("source1_entity_id", "target_entity_id", F.round(column(), 6).alias("similarity"))

    run.__name__ = name
    query(sql.over(f"SELECT source1_entity_id, target_entity_id, round({expression}, 6) AS similarity FROM j", *_SOURCES, more=[_TARGETS, f"j AS ({_TRUE})"], truth=True))(run)


_c = F.col
_only = lambda x, y: f"array_to_string(list_sort(list_filter(list_distinct(string_split({x}, ' ')), lambda t: NOT list_contains(string_split({y}, ' '), t))), ' ')"
_shared = "array_to_string(list_sort(list_filter(list_distinct(string_split(ac, ' ')), lambda t: list_contains(string_split(bc, ' '), t))), ' ')"
_sim_query("sim_indel", sql.indel("a", "b"), lambda: sim.levenshtein_ratio(_c("a"), _c("b")))
_sim_query("sim_jw", sql.jaro_winkler("a", "b"), lambda: sim.jaro_winkler_ratio(_c("a"), _c("b")))
_sim_query("sim_token_sort", sql.indel(sql.sorted_tokens("ac"), sql.sorted_tokens("bc")), lambda: sim.token_sort_ratio(_c("ac"), _c("bc")))
_sim_query("sim_jaccard", sql.jaccard("ta", "tb"), lambda: sim.jaccard(_c("ta"), _c("tb")))


def _token_set_sql(pairs: str) -> str:
    """Statement over pairs (ids, ac, bc): sets first, so that no string expression is written out twice."""
    return f"""SELECT source1_entity_id, target_entity_id, round(CASE WHEN ac = '' OR bc = '' THEN (CASE WHEN ac = bc THEN 1.0 ELSE 0.0 END) WHEN i <> '' AND (x = '' OR y = '') THEN 1.0
        WHEN i = '' THEN {sql.indel('x', 'y')} ELSE greatest({sql.indel('ix', 'iy')}, {sql.indel('i', 'ix')}, {sql.indel('i', 'iy')}) END, 6) AS similarity
      FROM (SELECT *, i || ' ' || x AS ix, i || ' ' || y AS iy FROM (SELECT *, {_shared} AS i, {_only('ac', 'bc')} AS x, {_only('bc', 'ac')} AS y FROM {pairs}))"""


_sim_query("sim_token_set", "0", lambda: sim.token_set_ratio(_c("ac"), _c("bc")))
ORACLES["sim_token_set"] = sql.over(_token_set_sql("j"), *_SOURCES, more=[_TARGETS, f"j AS ({_TRUE})"], truth=True)

_FEATURES_SQL = f"""
  SELECT p.source1_entity_id, p.candidate_entity_id,
    round({sql.indel('x.business_name_normalized', 'y.business_name_normalized')}, 6) AS name_levenshtein_ratio,
    round({sql.jaro_winkler('x.business_name_normalized', 'y.business_name_normalized')}, 6) AS name_jaro_winkler,
    round({sql.indel('x.business_name_core', 'y.business_name_core')}, 6) AS core_name_levenshtein_ratio,
    round({sql.indel(sql.sorted_tokens('x.business_name_core'), sql.sorted_tokens('y.business_name_core'))}, 6) AS core_name_token_sort_ratio,
    ts.similarity AS core_name_token_set_ratio,
    round({sql.jaccard('x.business_name_tokens', 'y.business_name_tokens')}, 6) AS name_token_jaccard,
    round(CASE WHEN m THEN 0.0 ELSE {sql.indel('x.business_address_normalized', 'y.business_address_normalized')} END, 6) AS address_levenshtein_ratio,
    round(CASE WHEN m THEN 0.0 ELSE {sql.jaccard('x.address_tokens', 'y.address_tokens')} END, 6) AS address_token_jaccard,
    CASE WHEN x.postal_code = y.postal_code AND x.postal_code <> '' THEN 1.0 ELSE 0.0 END::DOUBLE AS postal_code_match,
    CASE WHEN list_has_any(x.address_numbers, y.address_numbers) THEN 1.0 ELSE 0.0 END::DOUBLE AS address_number_match,
    CASE WHEN x.country_normalized = y.country_normalized AND x.country_normalized <> '' THEN 1.0 ELSE 0.0 END::DOUBLE AS country_match,
    CASE WHEN m THEN 1.0 ELSE 0.0 END::DOUBLE AS is_address_missing
  FROM (SELECT pa.*, x.business_address_normalized = '' OR y.business_address_normalized = '' AS m FROM pa JOIN s1_e x ON x.entity_id = source1_entity_id JOIN t_e y ON y.entity_id = candidate_entity_id) p
  JOIN s1_e x ON x.entity_id = p.source1_entity_id JOIN t_e y ON y.entity_id = p.candidate_entity_id
  JOIN ts ON ts.source1_entity_id = p.source1_entity_id AND ts.target_entity_id = p.candidate_entity_id
"""
_CORES = "c2 AS (SELECT pa.source1_entity_id, pa.candidate_entity_id AS target_entity_id, x.business_name_core AS ac, y.business_name_core AS bc FROM pa JOIN s1_e x ON x.entity_id = pa.source1_entity_id JOIN t_e y ON y.entity_id = pa.candidate_entity_id)"


@query(sql.over(_FEATURES_SQL, *_SOURCES, more=[*_PAIRS, _CORES, f"ts AS ({_token_set_sql('c2')})"]))
def pair_feature_vector(spark, d):
    s1, targets, t = _both(spark, d)
    out = pair_features(blocking.all_candidates(s1, targets), s1, t)
    return out.select("source1_entity_id", "candidate_entity_id", *[F.round(c, 6).alias(c) for c in FEATURES])


# Training sets ------------------------------------------------------------------------------------

@query(sql.over("SELECT * FROM truth_e", truth=True))
def truth_explode(spark, d):
    return _truth(spark, d)


@query(sql.over("SELECT t.* FROM truth_e t WHERE target_entity_id IN (SELECT entity_id FROM t_e)", "s2", "s3", more=[_TARGETS], truth=True))
def positive_pairs(spark, d):
    s1, s2, s3 = (testrecords.records(spark, d, s) for s in _SOURCES)
    return training.positives(_truth(spark, d), s1, s2.unionByName(s3))


_LABELLED = """lab AS (SELECT coalesce(p.source1_entity_id, t.source1_entity_id) AS source1_entity_id, coalesce(p.candidate_entity_id, t.target_entity_id) AS target_entity_id,
  CASE WHEN t.target_entity_id IS NULL THEN 0 ELSE 1 END::TINYINT AS label
  FROM p2 p FULL JOIN (SELECT * FROM truth_e WHERE target_entity_id LIKE 'S2%') t ON t.source1_entity_id = p.source1_entity_id AND t.target_entity_id = p.candidate_entity_id)"""


def _labelled(pairs: str, prefix: str, out: str) -> str:
    return _LABELLED.replace("lab AS", f"{out} AS").replace("FROM p2 p", f"FROM {pairs} p").replace("'S2%'", f"'{prefix}%'")


_LAB = [*_PAIRS, _labelled("pa", "S", "lab")]


@query(sql.over("SELECT * FROM lab", *_SOURCES, more=_LAB, truth=True))
def label_pairs(spark, d):
    s1, targets, t = _both(spark, d)
    return training.labelled(blocking.all_candidates(s1, targets), training.positives(_truth(spark, d), s1, t))


_HARD = """SELECT source1_entity_id, target_entity_id, label FROM (SELECT *, row_number() OVER (PARTITION BY source1_entity_id, label ORDER BY md5(concat_ws('|', source1_entity_id, target_entity_id, '42')), target_entity_id) AS n FROM lab) WHERE label = 1 OR n <= 2"""


@query(sql.over(_HARD, *_SOURCES, more=_LAB, truth=True))
def hard_negatives(spark, d):
    return training.cap_negatives(label_pairs(spark, d), 2)


@query(sql.over("SELECT source1_entity_id, target_entity_id, ('0x' || substr(md5(concat_ws('|', source1_entity_id, '42')), 1, 8))::BIGINT % 100 < 20 AS is_validation FROM truth_e", truth=True))
def group_split(spark, d):
    return training.grouped_split(_truth(spark, d))


@query(sql.over("SELECT entity_id FROM s1_e ORDER BY md5(concat_ws('|', entity_id, '42')), entity_id LIMIT 100", "s1"))
def sample_entities(spark, d):
    return training.sample_ids(testrecords.records(spark, d, "s1"), 100)


@query(sql.over("""SELECT source, label, count(*) AS n_pairs, count(DISTINCT source1_entity_id) AS n_entities FROM (
  SELECT *, row_number() OVER (PARTITION BY source, source1_entity_id, label ORDER BY md5(concat_ws('|', source1_entity_id, target_entity_id, '42')), target_entity_id) AS n FROM labs) WHERE label = 1 OR n <= 2 GROUP BY source, label""", "s1", "s2", "s3", more=[*_BOTH, _labelled("p2", "S2", "lab2"), _labelled("p3", "S3", "lab3"), "labs AS (SELECT *, 'S2' AS source FROM lab2 UNION ALL SELECT *, 'S3' FROM lab3)"], truth=True))
def training_composition(spark, d):
    """Pairs by source and label, of both targets, with two negatives an entity."""
    s1, s2, s3 = _records(spark, d, "s1", "s2", "s3")
    return training.composition(training.training_pairs(s1, {"S2": s2, "S3": s3}, _truth(spark, d), 2))


@query(sql.over(f"""SELECT source, label, count(*) AS n, round(avg(name_token_jaccard), 6) AS name_token_jaccard, sum(postal_code_match)::BIGINT AS postal_code_match, sum(is_address_missing)::BIGINT AS is_address_missing FROM (
  SELECT l.source, l.label, {sql.jaccard('x.business_name_tokens', 'y.business_name_tokens')} AS name_token_jaccard, CASE WHEN x.postal_code = y.postal_code AND x.postal_code <> '' THEN 1 ELSE 0 END AS postal_code_match,
    CASE WHEN x.business_address_normalized = '' OR y.business_address_normalized = '' THEN 1 ELSE 0 END AS is_address_missing
  FROM labs l JOIN s1_e x ON x.entity_id = l.source1_entity_id JOIN (SELECT * FROM s2_e UNION ALL SELECT * FROM s3_e) y ON y.entity_id = l.target_entity_id) GROUP BY source, label""", "s1", "s2", "s3",
  more=[*_BOTH, _labelled("p2", "S2", "lab2"), _labelled("p3", "S3", "lab3"), "labs AS (SELECT *, 'S2' AS source FROM lab2 UNION ALL SELECT *, 'S3' FROM lab3)"], truth=True))
def training_features(spark, d):
    """Features of all training pairs of both targets (all negatives), summed up by source and label."""
    s1, s2, s3 = _records(spark, d, "s1", "s2", "s3")
    targets = {"S2": s2, "S3": s3}
    rows = training.training_features(training.training_pairs(s1, targets, _truth(spark, d), 1 << 30), s1, targets)
    total = lambda c: F.sum(c).cast("long").alias(c)
    return rows.groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("name_token_jaccard"), 6).alias("name_token_jaccard"), total("postal_code_match"), total("is_address_missing"))


@query(sql.over("""SELECT entity_id FROM (SELECT entity_id, entity_id IN (SELECT target_entity_id FROM truth_e) AS needed, row_number() OVER (PARTITION BY entity_id IN (SELECT target_entity_id FROM truth_e) ORDER BY md5(concat_ws('|', entity_id, '42')), entity_id) AS n,
  count(*) FILTER (WHERE entity_id IN (SELECT target_entity_id FROM truth_e)) OVER () AS have FROM s2_e) WHERE needed OR n <= have / 10""", "s2", truth=True))
def target_sample(spark, d):
    s2, truth = testrecords.records(spark, d, "s2"), _truth(spark, d)
    return training.sample_targets(s2, training.required_targets(truth, "S2"), share=0.1).select("entity_id")


# Thresholds, matches, evaluation ------------------------------------------------------------------

_PRED = [*_PAIRS, sql.predictions("pa", "t", "pred")]
_GRID = f"""grid AS (SELECT unnest(range(10, 96)) / 100.0 AS threshold), cells AS (
  SELECT threshold, source1_entity_id, count(*) FILTER (WHERE ok) AS n_predicted, count(*) FILTER (WHERE ok AND hit) AS n_hit FROM (
    SELECT g.threshold, p.source1_entity_id, p.prediction_probability >= g.threshold AS ok, t.target_entity_id IS NOT NULL AS hit
    FROM grid g CROSS JOIN pred p LEFT JOIN truth_e t ON t.source1_entity_id = p.source1_entity_id AND t.target_entity_id = p.target_entity_id) GROUP BY ALL
), sized AS (SELECT c.*, (SELECT count(*) FROM truth_e t WHERE t.source1_entity_id = c.source1_entity_id) AS n_true FROM cells c),
sweep AS (SELECT threshold::DOUBLE AS threshold, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f05) AS macro_f05 FROM (SELECT threshold, {sql.scores('n_true', 'n_predicted', 'n_hit')} FROM sized) GROUP BY threshold)"""
_ROUNDED = "threshold, round(macro_precision, 6) AS macro_precision, round(macro_recall, 6) AS macro_recall, round(macro_f05, 6) AS macro_f05"


def _predictions(spark, d):
    s1, targets, t = _both(spark, d)
    return rule_predictions(blocking.all_candidates(s1, targets), s1, t)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" and c != "threshold" else F.col(c) for c, kind in df.dtypes])


@query(sql.over("SELECT * FROM pred", *_SOURCES, more=_PRED, truth=True))
def rule_scores(spark, d):
    return _predictions(spark, d)


@query(sql.over(f"SELECT {_ROUNDED} FROM sweep", *_SOURCES, more=[*_PRED, _GRID], truth=True))
def threshold_sweep(spark, d):
    return _rounded(threshold.sweep(_predictions(spark, d), _truth(spark, d)))


@query(sql.over(f"SELECT {_ROUNDED} FROM sweep ORDER BY round(sweep.macro_f05, 12) DESC, threshold DESC LIMIT 1", *_SOURCES, more=[*_PRED, _GRID], truth=True))
def best_threshold(spark, d):
    return _rounded(threshold.best(threshold.sweep(_predictions(spark, d), _truth(spark, d))))


_ENTITY = f"""SELECT source1_entity_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f05, 6) AS f05 FROM (SELECT e.entity_id AS source1_entity_id, {sql.scores('n_true', 'n_predicted', 'n_hit')} FROM (
  SELECT entity_id, (SELECT count(*) FROM truth_e t WHERE t.source1_entity_id = entity_id) AS n_true, (SELECT count(*) FROM pred p WHERE p.source1_entity_id = entity_id AND prediction_probability >= {LEAST}) AS n_predicted,
  (SELECT count(*) FROM pred p JOIN truth_e t ON t.source1_entity_id = p.source1_entity_id AND t.target_entity_id = p.target_entity_id WHERE p.source1_entity_id = entity_id AND prediction_probability >= {LEAST}) AS n_hit FROM s1_e) e)"""


@query(sql.over(_ENTITY, *_SOURCES, more=_PRED, truth=True))
def entity_f05(spark, d):
    said = matching.accepted(_predictions(spark, d), LEAST)
    return _rounded(threshold.entity_f05(said, _truth(spark, d), testrecords.records(spark, d, "s1").select("entity_id")))


_LISTS = f"""lists AS (SELECT e.entity_id AS source1_entity_id, coalesce((SELECT string_agg(DISTINCT q.target_entity_id, ',' ORDER BY q.target_entity_id) FROM (SELECT * FROM pred2 UNION ALL SELECT * FROM pred3) q
  WHERE q.source1_entity_id = e.entity_id AND q.prediction_probability >= {LEAST}), '') AS matched_entity_ids FROM s1_e e)"""
_MATCH = [*_BOTH, sql.predictions("p2", "s2", "pred2"), sql.predictions("p3", "s3", "pred3"), _LISTS]


@query(sql.over("SELECT * FROM lists", "s1", "s2", "s3", more=_MATCH))
def matching_results(spark, d):
    s1, s2, s3 = (testrecords.records(spark, d, s) for s in ("s1", "s2", "s3"))
    return match_by_rule(s1, {"S2": s2, "S3": s3}, LEAST)


@query(sql.over("""SELECT count(*) AS n_entities, count(*) FILTER (WHERE matched_entity_ids <> '') AS n_matched, count(*) FILTER (WHERE matched_entity_ids = '') AS n_singletons,
  sum(CASE WHEN matched_entity_ids = '' THEN 0 ELSE len(string_split(matched_entity_ids, ',')) END)::BIGINT AS n_links FROM lists""", "s1", "s2", "s3", more=_MATCH))
def match_stats(spark, d):
    return matching.statistics(matching_results(spark, d))


@query(sql.over("SELECT e.entity_id AS source1_entity_id, coalesce(string_agg(p.candidate_entity_id, ',' ORDER BY p.candidate_entity_id), '') AS candidate_entity_ids FROM s1_e e LEFT JOIN pa p ON p.source1_entity_id = e.entity_id GROUP BY e.entity_id", *_SOURCES, more=_PAIRS))
def candidate_lists(spark, d):
    s1, targets, _ = _both(spark, d)
    return matching.lists(s1, blocking.all_candidates(s1, targets), "candidate_entity_ids", "candidate_entity_id")


_OWNER = "SELECT source1_entity_id, target_entity_id, prediction_probability FROM (SELECT *, row_number() OVER (PARTITION BY target_entity_id ORDER BY prediction_probability DESC, source1_entity_id) AS n FROM pred) WHERE n = 1"


@query(sql.over(_OWNER, *_SOURCES, more=_PRED, truth=True))
def one_owner(spark, d):
    return matching.one_owner(_predictions(spark, d))


_FOUND = "(SELECT count(*) FROM pa p JOIN truth_e t ON t.source1_entity_id = p.source1_entity_id AND t.target_entity_id = p.candidate_entity_id)"


@query(sql.over(f"SELECT (SELECT count(*) FROM truth_e) AS n_truth, {_FOUND} AS n_found, round({_FOUND} * 1.0 / (SELECT count(*) FROM truth_e), 6) AS recall, (SELECT count(*) FROM pa) AS n_candidates, round((SELECT count(*) FROM pa) * 1.0 / (SELECT count(*) FROM s1_e), 6) AS candidates_per_entity", *_SOURCES, more=_PRED, truth=True))
def blocking_recall(spark, d):
    s1, targets, _ = _both(spark, d)
    return _rounded(evaluate.blocking_recall(blocking.all_candidates(s1, targets), _truth(spark, d), s1))


@query(sql.over("""SELECT t.source1_entity_id, t.target_entity_id, x.business_name AS source1_name, x.business_address AS source1_address, y.business_name AS target_name, y.business_address AS target_address
  FROM truth_e t JOIN s1_e x ON x.entity_id = t.source1_entity_id JOIN t_e y ON y.entity_id = t.target_entity_id
  WHERE NOT EXISTS (SELECT 1 FROM pz p WHERE p.source1_entity_id = t.source1_entity_id AND p.candidate_entity_id = t.target_entity_id)""", *_SOURCES, more=[*sql.pairs("s2", ("postal",), "y2"), *sql.pairs("s3", ("postal",), "y3"), "pz AS (SELECT * FROM y2 UNION ALL SELECT * FROM y3)", _TARGETS], truth=True))
def missed_pairs(spark, d):
    """What the postal pass alone would miss."""
    s1, targets, t = _both(spark, d)
    return evaluate.missed_report(blocking.all_candidates(s1, targets, passes=("postal",)), _truth(spark, d), s1, t)


_COUNTERS = {
    "names_changed": "business_name <> business_name_normalized", "suffixes_removed": "business_name_normalized <> business_name_core", "addresses_changed": "business_address <> business_address_normalized",
    "postal_codes": "postal_code <> ''", "addresses_with_numbers": "len(address_numbers) > 0", "countries_changed": "country <> country_normalized",
}


@query(sql.over("SELECT count(*) AS n_records, " + ", ".join(f"count(*) FILTER (WHERE {v}) AS {k}, round(count(*) FILTER (WHERE {v}) * 100.0 / count(*), 6) AS {k}_percent" for k, v in _COUNTERS.items()) + " FROM t_e", "s2", "s3", more=[_TARGETS]))
def norm_audit(spark, d):
    return _rounded(evaluate.audit(_both(spark, d)[2]))


@query(sql.over("""SELECT count(*) AS n_records, count(DISTINCT entity_id) AS n_ids, count(DISTINCT business_name) AS n_names, count(DISTINCT business_address) AS n_addresses, count(*) FILTER (WHERE trim(business_address) = '') AS missing_addresses,
  min(length(business_name)) AS min_name, max(length(business_name)) AS max_name, round(avg(length(business_name)), 6) AS avg_name FROM t_e""", "s2", "s3", more=[_TARGETS]))
def profile_missing(spark, d):
    return _rounded(evaluate.profile(testrecords.records(spark, d, "s2").unionByName(testrecords.records(spark, d, "s3"))))


@query("SELECT p_name AS value, count(*) AS n FROM part GROUP BY p_name ORDER BY n DESC, value LIMIT 20")
def name_frequency(spark, d):
    return evaluate.frequent(_table(spark, d, "part"), "p_name")


@query(sql.over("SELECT n AS n_matches, count(*) AS n_entities FROM (SELECT e.entity_id, count(t.target_entity_id) AS n FROM s1_e e LEFT JOIN truth_e t ON t.source1_entity_id = e.entity_id GROUP BY e.entity_id) GROUP BY n", "s1", truth=True))
def match_cardinality(spark, d):
    return evaluate.match_cardinality(_truth(spark, d), testrecords.records(spark, d, "s1").select("entity_id"))


@query(sql.over("SELECT sources, count(*) AS n_entities FROM (SELECT e.entity_id, coalesce(string_agg(DISTINCT substr(t.target_entity_id, 1, 2), '+' ORDER BY substr(t.target_entity_id, 1, 2)), 'none') AS sources FROM s1_e e LEFT JOIN truth_e t ON t.source1_entity_id = e.entity_id GROUP BY e.entity_id) GROUP BY sources", "s1", truth=True))
def source_overlap(spark, d):
    return evaluate.source_overlap(_truth(spark, d), testrecords.records(spark, d, "s1").select("entity_id"))


# Result files: the truth with faults put in ----------------------------------------------------------

_FAULTY = """SELECT source1_entity_id, CASE k % 50 WHEN 7 THEN concat(matched_entity_ids, ',S1-5') WHEN 8 THEN concat(matched_entity_ids, ',X9-1') WHEN 11 THEN concat('S2-1,S2-1,', matched_entity_ids) ELSE matched_entity_ids END AS matched_entity_ids
  FROM (SELECT {truth}) f WHERE k % 40 <> 3
  UNION ALL SELECT concat('S1-', cast(k + 900000000 as varchar(20))), 'S2-1' FROM base WHERE k % 100 = 1
  UNION ALL SELECT concat('S1-', cast(k as varchar(20))), '' FROM base WHERE k % 100 = 2""".format(truth="k, " + testrecords.TRUTH.strip().removeprefix("SELECT").strip())


def _issue_sql(name: str, rows: str) -> str:
    return f"SELECT '{name}' AS issue, (SELECT count(*) FROM ({rows}))::BIGINT AS n, coalesce((SELECT string_agg(e, ';' ORDER BY e) FROM (SELECT DISTINCT e FROM ({rows}) ORDER BY e LIMIT 5)), '') AS examples"


_FLAT = "flat AS (SELECT source1_entity_id, list_filter(string_split(matched_entity_ids, ','), lambda i: i <> '') AS ids FROM faulty), each AS (SELECT source1_entity_id, unnest(ids) AS id FROM flat)"


@query(sql.over(" UNION ALL ".join([
    _issue_sql("duplicate entity", "SELECT source1_entity_id AS e FROM faulty GROUP BY 1 HAVING count(*) > 1"),
    _issue_sql("duplicate id in list", "SELECT source1_entity_id AS e FROM flat WHERE len(ids) <> len(list_distinct(ids))"),
    _issue_sql("match within source 1", "SELECT source1_entity_id || '>' || id AS e FROM each WHERE id LIKE 'S1-%'"),
    _issue_sql("wrong prefix", "SELECT source1_entity_id || '>' || id AS e FROM each WHERE NOT regexp_matches(id, '^S[123]-')"),
    _issue_sql("missing entity", "SELECT entity_id AS e FROM s1_e WHERE entity_id NOT IN (SELECT source1_entity_id FROM faulty)"),
    _issue_sql("extra entity", "SELECT DISTINCT source1_entity_id AS e FROM faulty WHERE source1_entity_id NOT IN (SELECT entity_id FROM s1_e)"),
    _issue_sql("empty list", "SELECT source1_entity_id AS e FROM flat WHERE len(ids) = 0"),
    _issue_sql("unknown id", "SELECT source1_entity_id || '>' || id AS e FROM each WHERE id NOT IN (SELECT entity_id FROM s2_e UNION ALL SELECT entity_id FROM s3_e)"),
]), "s1", "s2", "s3", more=[f"faulty AS ({_FAULTY})", _FLAT]))
def validate_submission(spark, d):
    faulty = testrecords._run(spark, d, testrecords.with_base(_FAULTY))
    s1, s2, s3 = (testrecords.records(spark, d, s).select("entity_id") for s in ("s1", "s2", "s3"))
    return validate.issues(faulty, s1, known=s2.unionByName(s3))


# Files: written, read again and checked -----------------------------------------------------------

@query(sql.over("SELECT entity_id, business_name, business_address, country FROM s2_e", "s2"))
def tsv_records(spark, d):
    """Records through a TSV sink and source."""
    path = scratch_path(spark, "records")
    tsv.write_tsv(testrecords.records(spark, d, "s2").select(*RECORD), path)
    return tsv.read_records(spark, path)


@query(sql.over("SELECT entity_id, business_name FROM s2_e WHERE entity_id IN (SELECT target_entity_id FROM truth_e) ORDER BY entity_id LIMIT 500", "s2", truth=True))
def tsv_scan_ids(spark, d):
    """The first 500 records of a TSV file whose ids stand in the id file of the true targets."""
    records, ids = scratch_path(spark, "records"), scratch_path(spark, "ids")
    s2 = testrecords.records(spark, d, "s2").select(*RECORD)
    tsv.write_tsv(s2.unionByName(s2), records)
    tsv.write_tsv(_truth(spark, d).select("target_entity_id", "source1_entity_id"), ids)
    return tsv.head(tsv.with_ids(tsv.read_records(spark, records), tsv.read_id_set(spark, ids)), 500).select("entity_id", "business_name")


_WRITTEN = "SELECT source1_entity_id, matched_entity_ids, k % 20 = 3 AS broken FROM ({truth}) f".format(truth="SELECT k, " + testrecords.TRUTH.strip().removeprefix("SELECT").strip())
_READ = [f"written AS ({_WRITTEN})", "good AS (SELECT source1_entity_id, unnest(list_filter(string_split(matched_entity_ids, ','), lambda i: i <> '')) AS id FROM written WHERE NOT broken)"]


@query(sql.over(" UNION ALL ".join([
    _issue_sql("malformed row", "SELECT source1_entity_id || ' ' || matched_entity_ids AS e FROM written WHERE broken"),
    _issue_sql("duplicate entity", "SELECT '' AS e FROM written WHERE false"),
    _issue_sql("duplicate id in list", "SELECT '' AS e FROM written WHERE false"),
    _issue_sql("match within source 1", "SELECT '' AS e FROM written WHERE false"),
    _issue_sql("wrong prefix", "SELECT '' AS e FROM written WHERE false"),
    _issue_sql("missing entity", "SELECT source1_entity_id AS e FROM written WHERE broken"),
    _issue_sql("extra entity", "SELECT '' AS e FROM written WHERE false"),
    _issue_sql("empty list", "SELECT source1_entity_id AS e FROM written WHERE matched_entity_ids = '' AND NOT broken"),
    _issue_sql("match is no candidate", "SELECT source1_entity_id || '>' || id AS e FROM good WHERE id LIKE 'S3%'"),
]), "s1", more=_READ))
def validate_files(spark, d):
    """A result file with rows that lack their tab, checked against a candidate file without source 3."""
    results, offered = scratch_path(spark, "results"), scratch_path(spark, "offered")
    rows = testrecords._run(spark, d, testrecords.with_base(_WRITTEN))
    lines = rows.select(F.concat("source1_entity_id", F.when(F.col("broken"), " ").otherwise("\t"), "matched_entity_ids").alias("value"))
    tsv.write_lines(lines, f"source1_entity_id\t{validate.MATCHES}", results)
    s1 = testrecords.records(spark, d, "s1").select("entity_id")
    pairs = _truth(spark, d).filter(F.col("target_entity_id").startswith("S2"))
    tsv.write_tsv(matching.lists(s1, pairs, "candidate_entity_ids"), offered)
    candidates = tsv.read_tsv(spark, offered, ["source1_entity_id", "candidate_entity_ids"])
    return validate.issues(validate.read_result(spark, results, validate.MATCHES), s1, candidates=candidates)


# Models --------------------------------------------------------------------------------------------

_SCORED = "scored AS (SELECT l.quality AS label, round(d.n_chars / (d.n_chars + 1500.0), 4) AS s FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def _scored(spark, d):
    joined = _table(spark, d, "labels").join(_table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return joined.select(F.col("quality").alias("label"), F.round(F.col("n_chars") / (F.col("n_chars") + 1500.0), 4).alias("prediction_probability"))


@query(f"WITH {_SCORED}, g AS (SELECT s, sum(label) AS p, sum(1 - label) AS n FROM scored GROUP BY s), r AS (SELECT *, coalesce(sum(p) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tp FROM g) SELECT round(sum(n * (tp + p / 2.0)) / (sum(p) * sum(n)), 6) AS auc FROM r")
def auc(spark, d):
    return _rounded(model.roc_auc(_scored(spark, d)))


@query(f"WITH {_SCORED}, g AS (SELECT s, sum(label) AS p, count(*) AS c FROM scored GROUP BY s), r AS (SELECT *, sum(p) OVER w AS tp, sum(c) OVER w AS seen FROM g WINDOW w AS (ORDER BY s DESC)) SELECT round(sum(tp / seen * p) / sum(p), 6) AS average_precision FROM r")
def average_precision(spark, d):
    return _rounded(model.average_precision(_scored(spark, d)))


def _trained(spark, d):
    s1, s2, s3 = (testrecords.records(spark, d, s) for s in ("s1", "s2", "s3"))
    return train_and_match(s1, {"S2": s2, "S3": s3}, _truth(spark, d), trees=20, rate=0.1, depth=5, min_rows=5)


@query()
def gbt_score(spark, d):
    """Trained from the records themselves; no engine gives the same trees, so rows only."""
    return _trained(spark, d)[0]


@query(sql.over("SELECT (SELECT count(*) FROM pa) AS n_scored, true AS auc_at_least_95, true AS f05_at_least_90", *_SOURCES, more=_PAIRS))
def gbt_quality(spark, d):
    """What holds of any good trees: all candidates scored, the truth ranked first, the best threshold worth it."""
    scored, best, _ = _trained(spark, d)
    marked = scored.join(_truth(spark, d).withColumn("label", F.lit(1)), ["source1_entity_id", "target_entity_id"], "left").na.fill(0, ["label"])
    marked = written(marked.select("label", "prediction_probability"), "scored")
    total = marked.agg(F.count(F.lit(1)).alias("n_scored"))
    return total.join(F.broadcast(model.roc_auc(marked)), F.lit(True)).select("n_scored", (F.col("auc") >= 0.95).alias("auc_at_least_95"), F.lit(best["macro_f05"] >= 0.9).alias("f05_at_least_90"))


@query(sql.over("SELECT count(*) AS n_pairs, sum(label)::BIGINT AS n_positive, true AS auc_at_least_95 FROM lab", *_SOURCES, more=_LAB, truth=True))
def leafwise_quality(spark, d):
    """What holds of regularised leaf-wise trees, trained on one side of a split by entity: every labelled pair scored, held-out truth ranked first."""
    s1, targets, _ = _both(spark, d)
    pairs = training.training_pairs(s1, targets, _truth(spark, d), most=1 << 30)
    rows = written(training.grouped_split(training.training_features(pairs, s1, targets)), "leafwise")
    fitted = boosting.train(rows, trees=8, rate=0.3, leaves=8, min_rows=20, patience=4)
    scored = written(boosting.score(fitted, rows).select("label", "is_validation", "prediction_probability"), "scored")
    total = scored.agg(F.count("prediction_probability").alias("n_pairs"), F.sum(F.col("label").cast("long")).alias("n_positive"))
    return total.join(F.broadcast(model.roc_auc(scored.filter("is_validation"))), F.lit(True)).select("n_pairs", "n_positive", (F.col("auc") >= 0.95).alias("auc_at_least_95"))


_ORDERED = """ordered AS (SELECT *, row_number() OVER (ORDER BY country, key, side, id) AS pos FROM (
  SELECT country_normalized AS country, business_name_core AS key, 1 AS side, entity_id AS id FROM s1_e
  UNION ALL SELECT country_normalized, business_name_core, 2, entity_id FROM t_e))"""


@query(sql.over("SELECT DISTINCT a.id AS source1_entity_id, b.id AS candidate_entity_id FROM ordered a JOIN ordered b ON abs(a.pos - b.pos) < 10 AND a.country = b.country WHERE a.side = 1 AND b.side = 2", *_SOURCES, more=[_TARGETS, _ORDERED]))
def block_neighbours(spark, d):
    """Sorted neighbourhood by core name, a window of 10."""
    s1, _, targets = _both(spark, d)
    return neighbours.neighbour_pairs(s1, targets, 10)


def _grams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(1, length({x}) - 2) + 1), lambda i: substr({x}, i, 3)))"


_GRAMS = [f"g{n} AS (SELECT entity_id, country_normalized AS c, {_grams('business_name_normalized')} AS g FROM {side} WHERE business_name_normalized <> '')" for n, side in ((1, "s1_e"), (2, "t_e"))]


@query(sql.over("""SELECT a.entity_id AS source1_entity_id, b.entity_id AS candidate_entity_id FROM g1 a JOIN g2 b ON a.c = b.c AND len(a.g) >= 0.6 * len(b.g) - 0.001 AND len(b.g) >= 0.6 * len(a.g) - 0.001
  WHERE len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))::DOUBLE >= 0.6""", *_SOURCES, more=[_TARGETS, *_GRAMS]))
def block_qgrams(spark, d):
    """Names with a Jaccard similarity of 0.6 over 3-grams."""
    s1, _, targets = _both(spark, d)
    return qgrams.qgram_pairs(s1, targets, 0.6, 3)

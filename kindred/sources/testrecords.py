"""Business records with known truth, made from the customer, nation and region tables.

The statements use functions that Spark and DuckDB share, so both engines see the same records. Names are
made of letters of the key's MD5; the second and third source differ from the first by fixed faults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_LETTERS = "translate(md5(concat('{salt}', cast(k as varchar(20)))), '0123456789', 'ghijklmnop')"
_WORDS = f"concat(substr({_LETTERS}, 1, 6), ' ', substr({_LETTERS}, 7, 5))"

BASE = """
  SELECT c_custkey AS k, translate(n_name, '_0123456789', 'xabcdefghij') AS nation, r_name AS region,
         {words} AS words, {other} AS other,
         substr({letters}, 13, 7) AS street,
         cast(10000 + (c_custkey * 37) % 89999 as varchar(10)) AS zip,
         CASE WHEN c_custkey % 50 = 6 THEN ' Ltd Inc Ltd Inc Ltd Inc Ltd Inc Ltd Inc Ltd Inc' ELSE CASE c_custkey % 5 WHEN 0 THEN ' LLC' WHEN 1 THEN ' Pvt. Ltd.' WHEN 2 THEN ' Inc' WHEN 3 THEN ' Corp' ELSE '' END END AS form
  FROM (SELECT *, c_custkey AS k FROM customer) c
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""".format(words=_WORDS.format(salt="a"), other=_WORDS.format(salt="z"), letters=_LETTERS.format(salt="s"))

_ADDRESS = "concat(cast(100 + k as varchar(20)), ' ', street, ' Road, ', nation, ', CA ', zip)"
_MOVED = "concat('CA ', zip, ', ', nation, ', ', cast(100 + k as varchar(20)), ' ', street, ' Rd')"

SOURCES = {
    "s1": f"SELECT concat('S1-', cast(k as varchar(20))) AS entity_id, concat(CASE WHEN k % 7 = 0 THEN replace(words, 'a', 'á') ELSE words END, form) AS business_name, {_ADDRESS} AS business_address, region AS country FROM base",
    "s2": f"""
      SELECT concat('S2-', cast(k as varchar(20))) AS entity_id,
             CASE k % 4 WHEN 0 THEN upper(concat(words, form)) WHEN 1 THEN concat('[', trim(form), '] ', words)
                        WHEN 2 THEN concat(substr(words, 1, 11), form) ELSE concat(words, ' & Co', form) END AS business_name,
             CASE WHEN k % 30 = 4 THEN '' WHEN k % 6 = 3 THEN {_MOVED} ELSE {_ADDRESS} END AS business_address, lower(region) AS country
      FROM base WHERE k % 10 <> 9
      UNION ALL
      SELECT concat('S2-', cast(k + 100000000 as varchar(20))), concat(other, form), concat(cast(7 * k + 3 as varchar(20)), ' ', substr(other, 1, 6), ' Street, ', nation), region FROM base WHERE k % 4 = 1
    """,
    "s3": f"""
      SELECT concat('S3-', cast(k as varchar(20))) AS entity_id, concat(substr(words, 8, 5), ' ', substr(words, 1, 6), form) AS business_name,
             CASE WHEN k % 33 = 1 THEN '' ELSE {_MOVED} END AS business_address, region AS country
      FROM base WHERE k % 3 <> 0
    """,
}

TRUTH = """
  SELECT concat('S1-', cast(k as varchar(20))) AS source1_entity_id,
         concat_ws(',', CASE WHEN k % 10 <> 9 THEN concat('S2-', cast(k as varchar(20))) END, CASE WHEN k % 3 <> 0 THEN concat('S3-', cast(k as varchar(20))) END) AS matched_entity_ids
  FROM base
"""


#: Addresses of every shape of postal code, and of numbers that are none: (address, code), by k modulo their number.
_SHAPES = [
    ("concat(nation, ' ', zip, '-', substr(zip, 1, 4), ' ', street, ' Way')", "''"),
    ("concat('Box Hall, ', nation, ', TX ', zip, '-', substr(zip, 1, 4))", "concat(zip, '-', substr(zip, 1, 4))"),
    ("concat(street, ' near tower, pin code: ', six, ' ', nation)", "six"),
    ("concat(street, ' zip ', zip, ', Road')", "zip"),
    ("concat(street, ' zip ', zip, ' Road')", "''"),
    ("concat(street, ' postal code ', substr(ca, 1, 3), ' ', substr(ca, 4, 3))", "upper(ca)"),
    ("concat(nation, ', ON ', substr(ca, 1, 3), ' ', substr(ca, 4, 3))", "upper(ca)"),
    ("concat(nation, ', ', ca, ' ', street, ' Avenue')", "''"),
    ("concat(nation, ', EC1A ', substr(zip, 5, 1), 'BB')", "concat('EC1A ', substr(zip, 5, 1), 'BB')"),
    ("concat(nation, ', ec1a ', substr(zip, 5, 1), 'bb')", "''"),
    ("concat(street, ', ', nation, ' - ', six)", "six"),
    ("concat(street, ' ', nation, ' ', six, ', India')", "six"),
    ("concat(street, ' ', nation, ' ', six, ' ', street)", "''"),
    ("concat('Plot ', six, ', ', nation)", "''"),
    ("concat(street, ', ', nation, ', NY ', zip, ', USA')", "zip"),
    ("concat(street, ', ', zip, ' ', nation)", "zip"),
    ("concat(street, ', ', zip, ' Lane ', nation)", "''"),
    ("concat(street, ', ', zip, ' old ', nation, ' mill lane')", "''"),
    ("concat(street, ', 00', substr(zip, 1, 3), ' ', nation)", "''"),
    ("concat(nation, zip)", "zip"),
    ("concat(zip, ' ', nation)", "''"),
    ("concat(nation, ', unit ', zip)", "''"),
    ("concat('# ', zip)", "''"),
]
_SHAPED = "SELECT k, street, nation, zip, concat(zip, '7') AS six, concat('k', substr(zip, 1, 1), 'a', substr(zip, 2, 1), 'b', substr(zip, 3, 1)) AS ca FROM base"


def _by_shape(at: int) -> str:
    return f"CASE k % {len(_SHAPES)} " + " ".join(f"WHEN {i} THEN {s[at]}" for i, s in enumerate(_SHAPES)) + " END"


SHAPED_ADDRESSES = f"SELECT k, {_by_shape(0)} AS business_address FROM ({_SHAPED})"
SHAPED_CODES = f"SELECT k, {_by_shape(0)} AS business_address, {_by_shape(1)} AS postal_code FROM ({_SHAPED})"


def with_base(sql: str, *more: str) -> str:
    """A statement over `base` and the named sources, complete for either engine."""
    parts = [f"base AS ({BASE})", *[f"{name} AS ({SOURCES[name]})" for name in more]]
    return f"WITH {', '.join(parts)} {sql}"


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation", "region")}
    # A file of one row group is read by one task whatever its size; what is made of its rows costs far more than they do.
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tables["customer"] = tables["customer"].repartition(tasks, "c_custkey")
    for name in tables:
        sql = sql.replace(f"FROM {name})", f"FROM {{{name}}})").replace(f"JOIN {name} ", f"JOIN {{{name}}} ")
    return spark.sql(sql, **tables)


def records(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    return _run(spark, sf_dir, with_base(SOURCES[source]))


def shaped_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, with_base(SHAPED_ADDRESSES))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, with_base(TRUTH))

import random

import pytest
from pyspark.sql import functions as F

from kindred.functions import similarity as sim
from kindred.functions import text as fn
from kindred.functions.postal import postal_code
from kindred.operators import blocking

NAMES = [  # raw, normalised, core
    ("QRS PVT. LTD.", "qrs pvt ltd", "qrs"), ("Qrs  Pvt Ltd", "qrs pvt ltd", "qrs"), ("  LUNA   CORPORATION ", "luna corporation", "luna"),
    ("~~ Birch Cove Bakery Inc", "birch cove bakery inc", "birch cove bakery"), ("!!! Tin Kettle LLC", "tin kettle llc", "tin kettle"),
    ("Marble, {{LLC}}", "marble llc", "marble"), ("[(Repair)] Old Mill Tools, LLC", "repair old mill tools llc", "repair old mill tools"),
    ("Otter & Finch", "otter and finch", "otter and finch"), ("OTTER-FNICH", "otter fnich", "otter fnich"), ("Otter + Finch", "otter and finch", "otter and finch"),
    ("Pine Gate / Row", "pine gate row", "pine gate row"), ("Ottér Cafés", "otter cafes", "otter cafes"),
    ("Lumière Voisins Groupe S.A.S", "lumiere voisins groupe sas", "lumiere voisins groupe"),
    ("गंगा धागा प्राइवेट लिमिटेड", "गंगा धागा प्राइवेट लिमिटेड", "गंगा धागा"), ("கடல் மீன் எல்எல்பி", "கடல் மீன் எல்எல்பி", "கடல் மீன்"),
    (None, "", ""), ("", "", ""), ("   ", "", ""), ("None", "", ""), ("z brewing company company", "z brewing company company", "z brewing"),
    ("LLC Harbour Crew", "llc harbour crew", "harbour crew"), ("Ltd", "ltd", "ltd"), ("\ufb02int Forge", "flint forge", "flint forge"),
]

# One or more for each rule and each refusal: address, code.
CODES = [
    ("Harbour House, Dover, DE 19901-4455", "19901-4455"),
    ("88 19901-4455 Quince Road", ""),
    ("Behind the mill, pincode 411014 Pune", "411014"),
    ("7 Tulip Lane, zip: 30301, Elm Street", "30301"),
    ("7 Tulip Lane, zip: 30301 Elm Street", ""),  # what follows a label is up to ten letters, digits and blanks
    ("Postal Code - m4b 1b3, Toronto", "M4B1B3"),
    ("zip code ec1a1bb", "EC1A1BB"),
    ("pin 12", ""),
    ("9 Lakeshore, Halifax NS B3H 4R2", "B3H4R2"),
    ("9 Lakeshore, Halifax NS b3h-4r2", "B3H-4R2"),
    ("Halifax, B3H 4R2 Lakeshore Drive", ""),
    ("Flat A, Leeds LS2 9JT", "LS2 9JT"),
    ("Leeds ls2 9jt", ""),
    ("Temple View, Mysore - 570001", "570001"),
    ("Temple View, 570001 Mysore", "570001"),
    ("Temple View Mysore 570001", "570001"),
    ("Temple View Mysore 570001, Bharat", "570001"),
    ("Temple View Mysore 570001 Karnataka", ""),
    ("Phone 570001", ""),
    ("Po Box 570001", ""),
    ("5 Oak Court, Reno, NV 89501", "89501"),
    ("5 Oak Court, Reno, NV 89501, USA", "89501"),
    ("Reno, 89501 Nevada", "89501"),
    ("Reno, 89501 Oak Court", ""),
    ("Reno, 89501 the very old oak court", ""),
    ("Reno, 89501 a b c d e court", "89501"),
    ("Reno, 00501 Nevada", ""),
    ("Reno, 89501 4th", ""),
    ("Shop no. 89501, Reno", ""),
    ("Reno 89501", "89501"),
    ("Reno 00895", ""),
    ("89501 Reno", ""),
    ("#, 89501 Reno", ""),
    ("89501", ""),
    ("", ""),
    ("   ", ""),
    (None, ""),
]


def test_names(spark):
    df = spark.createDataFrame([(i, n) for i, (n, *_) in enumerate(NAMES)], "i int, n string").select("i", fn.normalize_business_name(F.col("n")).alias("norm"))
    got = {r.i: (r.norm, r.core) for r in df.select("i", "norm", fn.core_name(F.col("norm")).alias("core")).collect()}
    for i, (raw, norm, core) in enumerate(NAMES):
        assert got[i] == (norm, core), raw


def test_postal_codes(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CODES)], "i int, a string")
    got = {r.i: r.code for r in df.select("i", postal_code(F.col("a")).alias("code")).collect()}
    assert {a: got[i] for i, (a, _) in enumerate(CODES)} == dict(CODES)


def test_a_word_that_begins_like_a_label_is_none(spark):
    codes = {"pinfnbb near tower, pin code: 983487 Nation": "983487", "pinfdhc zip 42886, Road": "42886", "x, PIN600001": "600001", "x zipK1A 0B1": "K1A0B1", "pinned, zip ab1 2cd": "AB1 2CD", "pinned 12345 zip": ""}
    df = spark.createDataFrame([(a,) for a in codes], "a string")
    assert {r.a: r.code for r in df.select("a", postal_code(F.col("a")).alias("code")).collect()} == codes


def test_core_name_takes_all_legal_forms(spark):
    names = {"acme" + " ltd inc" * 12: "acme", "llc acme" + " pvt ltd co" * 9: "acme", "x holding company company": "x holding", "ltd ltd": "ltd"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.c for r in df.select("n", fn.core_name(F.col("n")).alias("c")).collect()} == names


def test_numbers_countries_addresses(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    for address, want in [
        ("45, K.P. Street, Salem - 636001", ["45", "636001"]), ("7(12), B.A. Nagar, 3Rd Cross", ["7", "12", "3rd"]), ("22/31B/9 Kovil Tower", ["22/31b/9"]),
        ("Zx-19, Oakfield. No. 77, 5550123", ["zx-19", "77", "5550123"]), (None, []), ("", []),
    ]:
        assert value(fn.address_numbers(F.lit(address).cast("string"))) == want
    for country, want in [("US", "US"), ("us", "US"), ("  uS  ", "US"), ("India", "India"), ("INDIA", "India"), ("FRANCE", "France"), ("FR", "FR"), ("germany", "Germany"), ("new-delhi", "New-Delhi"), ("", ""), (None, "")]:
        assert value(fn.normalize_country(F.lit(country).cast("string"))) == want
    assert value(fn.normalize_address(F.lit("'12',M.G. Road ,, [Chennai] - 600001;"))) == "12, m g road, chennai 600001"
    assert value(fn.address_tokens(F.lit("12, m g road, -chennai. 600001"))) == ["12", "m", "g", "road", "chennai", "600001"]
    assert [value(fn.strip_web_domain(F.lit(t))) for t in ("x.com", ".com", "a.co", "b.com.in")] == ["x", ".com", "a", "b.com"]


def test_enrich_fills_missing_columns(spark):
    df = spark.createDataFrame([("S1-1", None, 3)], "entity_id string, business_name string, extra int")
    out = fn.enrich(df)
    assert out.columns[:5] == ["entity_id", "business_name", "business_address", "country", "extra"]
    row = out.first()
    assert row.business_name_tokens == [] and row.postal_code == "" and row.country_normalized == ""


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_similarities():
    rng = random.Random(4)
    for _ in range(400):
        a, b = ("".join(rng.choices("abcd ", k=rng.randint(0, 14))) for _ in range(2))
        want = 1.0 if a == b else 0.0 if not a or not b else 2 * lcs(a, b) / (len(a) + len(b))
        assert sim.indel(a, b) == pytest.approx(want)
    assert sim.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert sim.jaro_winkler("abcdxyz", "abcqrst") == pytest.approx(0.619048, abs=1e-6)
    assert sim.token_set("a b c", "c a") == 1.0 and sim.token_set("", "") == 1.0 and sim.token_set("", "a") == 0.0


def test_keys_are_counted_before_they_are_joined(spark):
    rows = spark.createDataFrame([("a", "Luna Works", "12 Fir Road, CA 12345", "US")], "entity_id string, business_name string, business_address string, country string")
    pairs = blocking.candidate_pairs(rows, rows)
    assert "sum(l" not in pairs._jdf.queryExecution().optimizedPlan().toString() and pairs.count() == 1


def test_gated_rules_see_what_they_are_for(spark):
    texts = ["none", "a<null>b", "x & y + z+", "a.b.c  d", "-a -b c-d- e", "\t a   b c d", "shop.com", "com", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    t = F.col("t")
    rows = df.select(fn.normalize_text(t), fn.normalize_business_name(t), fn.normalize_address(t), fn.strip_web_domain(t)).collect()
    assert [r[0] for r in rows] == ["", "a b", "x and y and z", "a.b.c d", "a -b c-d- e", "a b c d", "shop.com", "com", ""]
    assert [r[1] for r in rows][2:5] == ["x and y and z", "abc d", "a b c d e"]
    assert [r[2] for r in rows][4] == "a b c-d e" and [r[3] for r in rows][6:] == ["shop", "com", None]


def test_look_behinds_run_only_where_a_code_and_what_must_follow_it_stand():
    from kindred.functions import postal

    # The first condition of each rule holds what must stand behind the code, so that other numbers cost one look.
    for rule, code in ((postal._ZIP_LAST, postal.ZIP), (postal._ZIP_INSIDE, postal.ZIP), (postal._PIN, postal.PIN)):
        first = rule[: rule.index("(?<")]
        assert first.startswith("(?=") and code in first and (first.count("$") or postal.RIGHT in rule[: rule.index("(?<!(?:^")])


def test_names_without_a_form_at_the_end_keep_their_words(spark):
    from pyspark.sql import functions as F

    from kindred.functions.text import core_name

    cases = [("acme trading inc", "acme trading"), ("acme inc trading", "acme inc trading"), ("acme ltd inc ltd", "acme"), ("inc", "inc"), ("acme incx", "acme incx"), ("one two", "one two"), ("", "")]
    rows = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(cases)], "i int, n string")
    column = core_name(F.col("n"))
    assert [r.c for r in rows.select("i", column.alias("c")).orderBy("i").collect()] == [c for _, c in cases]
    # A name is searched only if its last word is that of a form.
    assert "substring_index" in rows.select(column.alias("c"))._jdf.queryExecution().optimizedPlan().toString()

"""Word lists of the record model. All of these are fixed values that results depend on."""

# Legal forms that end a business name.
LEGAL_SUFFIXES = [
    "private limited", "pvt limited", "pvt ltd", "private ltd", "public limited company",
    "limited liability partnership", "limited liability company", "professional corporation",
    "holding company", "holdings limited", "holdings inc", "ventures private limited",
    "ventures limited", "producer company",
    "limited", "ltd", "pvt", "private", "llc", "inc", "incorporated", "corp", "corporation", "plc",
    "co", "company", "llp", "pc", "pllc", "lp", "sarl", "sas", "sa", "sci", "gmbh", "ag", "bv", "nv", "dba",
    "எல்எல்பி", "பிரைவேட் லிமிடெட்", "பிரைவேட்", "லிமிடெட்",
    "प्राइवेट लिमिटेड", "प्राइवेट", "लिमिटेड", "प्रा लि", "प्रा. लि.", "प्रा.लि.", "एलएलपी",
    "પ્રાઇવેટ લિમિટેડ", "પ્રાઇવેટ", "લિમિટેડ",
    "ప్రైవేట్ లిమిటెడ్", "లిమిటెడ్", "ప్రైవేట్",
    "പ്രൈവറ്റ് ലിമിറ്റഡ്", "ലിമിറ്റഡ്",
]

# Legal forms that may stand alone before a name.
LEGAL_PREFIXES = [
    "llc", "inc", "corp", "corporation", "incorporated", "ltd", "limited", "pvt", "private", "sarl", "sas", "sa",
    "sci",
]

# Words after a number that make it a street number.
STREET_WORDS = [
    "road", "rd", "street", "st", "str", "avenue", "ave", "av", "drive", "dr", "lane", "ln", "highway", "hwy",
    "boulevard", "blvd", "court", "ct", "way", "place", "pl", "terrace", "ter", "terr", "trail", "trl", "route",
    "rte", "rt", "circle", "cir", "parkway", "pkwy", "pky", "loop", "lp", "loip", "square", "sq", "alley", "aly",
    "crescent", "cres", "crossing", "xing", "run", "walk", "row", "path", "turnpike", "tpke", "tpk", "expressway",
    "expy", "expw", "freeway", "fwy", "causeway", "cswy", "broadway", "pass", "passage", "trace", "trce", "bend",
    "glen", "ridge", "rdg", "cove", "cv", "hill", "hills", "hl", "hls", "cross", "bypass", "byp", "plaza", "plz",
    "gardens", "gdn", "gdns", "grove", "grv", "mews", "close", "cl", "point", "pt", "rise", "view", "vw", "valley",
    "vly", "station", "stn", "parade", "pde", "walkway", "mall", "promenade", "esplanade", "quay", "wharf",
    "overpass", "extension", "ext", "roadways", "express", "gali", "marg", "rasta", "nagar", "colony", "enclave",
]

# Words before a number that make it a unit, door or phone number. The phrases that do so too
# (such as house no, po box) all end in one of them.
UNIT_WORDS = [
    "no", "no.", "h.no", "h.no.", "hn", "house", "door", "flat", "plot", "site", "shop", "shp", "unit", "suite",
    "ste", "apt", "apartment", "bldg", "building", "room", "rm", "fl", "floor", "block", "blk", "sector", "sec",
    "ph", "phone", "tel", "cell", "mob", "mobile", "box", "po", "pmb", "dept", "department", "khasra", "kh",
    "survey", "sr", "w.no", "ward",
]

# Name words that are no blocking key.
NAME_NOISE = [
    "private", "limited", "pvt", "ltd", "inc", "llc", "corp", "co", "and", "company",
]

# Address words that are no blocking key.
ADDRESS_NOISE = [
    "road", "rd", "street", "st", "avenue", "ave", "lane", "ln", "drive", "dr", "boulevard", "blvd", "highway",
    "hwy", "way", "place", "pl", "building", "bldg", "floor", "fl", "flat", "apartment", "apt", "unit", "block",
    "near", "opposite", "opp", "behind", "beside", "next", "house", "no", "city", "district", "state", "county",
    "india", "usa", "us", "private", "limited", "pvt", "ltd", "inc", "llc", "corp", "company", "and",
]

# Web endings that are cut from a name's word.
WEB_ENDINGS = ["com", "in", "org", "net", "co", "io", "biz", "info"]

RECORD = ["entity_id", "business_name", "business_address", "country"]
DERIVED = [
    "business_name_normalized", "business_name_core", "business_name_tokens", "business_address_normalized",
    "address_tokens", "address_numbers", "postal_code", "country_normalized",
]
FEATURES = [
    "name_levenshtein_ratio", "name_jaro_winkler", "core_name_levenshtein_ratio", "core_name_token_sort_ratio",
    "core_name_token_set_ratio", "name_token_jaccard", "address_levenshtein_ratio", "address_token_jaccard",
    "postal_code_match", "address_number_match", "country_match", "is_address_missing",
]

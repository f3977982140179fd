"""Normalisation of names, addresses and countries as column expressions.

Only Unicode decomposition has no builtin; it is an Arrow UDF over whole batches, which hands ASCII
batches back untouched. Java's classes differ from those the rules are defined with, so word and
blank characters are spelled out: WORD is letters, numbers and underscore of any script, without marks.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kindred.functions.constants import DERIVED, LEGAL_PREFIXES, LEGAL_SUFFIXES, RECORD, WEB_ENDINGS
from kindred.functions.once import once
from kindred.functions.postal import postal_code

WORD = r"\p{L}\p{N}_"
BLANK = r"\s\x1c-\x1f\x85\p{Z}"
INDIC = r"\x{0900}-\x{0D7F}"


def _fold(text: str) -> str:
    kept = (c for c in unicodedata.normalize("NFKD", text) if not ("̀" <= c <= "ͯ" and unicodedata.category(c) == "Mn"))
    return unicodedata.normalize("NFC", "".join(kept))


@F.arrow_udf(StringType())
def _fold_batch(texts: pa.Array) -> pa.Array:
    if pc.all(pc.fill_null(pc.string_is_ascii(texts), True)).as_py() is not False:
        return texts
    return pa.array([t if t is None or t.isascii() else _fold(t) for t in texts.to_pylist()], pa.string())


def strip_latin_diacritics(text: Column) -> Column:
    """Compatibility decomposition without the marks U+0300 to U+036F, composed again; Indic signs stay."""
    return _fold_batch(text)


def collapse(text: Column) -> Column:
    # Single spaces, nearly all blanks there are, stay as they are.
    return F.trim(F.regexp_replace(text, f"[{BLANK}]{{2,}}|[{BLANK}&&[^ ]]", " "))


def normalize_folded(folded: Column) -> Column:
    """normalize_text for a text without Latin marks."""
    edge = f"[^{WORD}{BLANK}{INDIC}]+"
    before, after = f"(?<![{WORD}])", f"(?![{WORD}])"
    # Between word characters "<null>" goes with its brackets; elsewhere only the word goes.
    null = f"(?<=[{WORD}])<(?:null|none)>(?=[{WORD}])|{before}(?:null|none){after}"
    lone = rf"(?<=[{BLANK}])\+(?=[{BLANK}])"
    # Look-behinds are tried at every place of a text: only where their word or sign is there at all.
    out = once(F.lower(F.coalesce(folded, F.lit(""))), lambda t: F.when(t.contains("null") | t.contains("none"), F.regexp_replace(t, null, " ")).otherwise(t))
    out = once(out, lambda t: F.when(t.contains("&") | t.contains("+"), F.regexp_replace(F.replace(t, F.lit("&"), F.lit(" and ")), lone, " and ")).otherwise(t))
    return collapse(F.regexp_replace(out, f"^{edge}|{edge}$", " "))


def normalize_text(text: Column) -> Column:
    return normalize_folded(strip_latin_diacritics(text))


def business_name_of(normalized: Column) -> Column:
    """normalize_business_name for a normalised text."""
    initial = rf"(?<=(?<![{WORD}])[a-zA-Z])\.(?=[a-zA-Z](?![{WORD}]))"
    out = once(normalized, lambda t: F.when(t.contains("."), F.regexp_replace(t, initial, "")).otherwise(t))
    return collapse(F.regexp_replace(F.regexp_replace(out, r"[-_/\\|+]+", " "), r"[\p{P}\p{S}]", " "))


def normalize_business_name(name: Column) -> Column:
    return business_name_of(normalize_text(name))


def name_tokens(normalized: Column) -> Column:
    return F.filter(F.split(F.coalesce(normalized, F.lit("")), f"[{BLANK}]+"), lambda t: t != "")


def core_name(normalized: Column, suffixes: list[str] | None = None, prefixes: list[str] | None = None) -> Column:
    """A normalised name without the legal forms at its end, and one at its start; never empty."""
    ordered = sorted({s.lower().strip() for s in (LEGAL_SUFFIXES if suffixes is None else suffixes)}, key=lambda s: (-len(s), s))
    ending = "(?:" + "|".join(rf"(?: {re.escape(s)})+" for s in ordered) + ")$"
    # Most names do not end in the last word of a form: they are not searched.
    lasts = sorted({s.split(" ")[-1] for s in ordered})
    shorter = lambda name: F.when(F.substring_index(name, " ", -1).isin(lasts), F.regexp_replace(name, ending, "")).otherwise(name)
    # A round takes at least one word or changes nothing, so as many rounds as words reach the end of it. What is held is
    # the name and what it was a round before: once they are equal there is nothing left to do.
    start = F.array(normalized, F.lit(None).cast("string"))
    last = F.aggregate(F.split(normalized, " "), start, lambda a, _: F.when(F.get(a, F.lit(0)) == F.get(a, F.lit(1)), a).otherwise(F.array(shorter(F.get(a, F.lit(0))), F.get(a, F.lit(0)))))
    core = F.get(last, F.lit(0))
    starts = "|".join(map(re.escape, LEGAL_PREFIXES if prefixes is None else prefixes))
    core = F.regexp_replace(core, f"^(?:{starts}) (?=.)", "")
    return F.coalesce(F.nullif(core, F.lit("")), normalized)


def address_of(normalized: Column) -> Column:
    """normalize_address for a normalised text."""
    out = F.regexp_replace(normalized, r"""['"`’‘\[\](){}<>#@~*^$]""", " ")
    out = F.regexp_replace(out, f"[{BLANK}]*,[{BLANK}]*", ", ")
    out = F.regexp_replace(out, f"(?:,[{BLANK}]*)+,", ",")
    out = once(out, lambda t: F.when(t.contains("-"), F.regexp_replace(t, "(?<![a-zA-Z0-9])-|-(?![a-zA-Z0-9])", " ")).otherwise(t))
    out = F.regexp_replace(out, f"[^{WORD}{BLANK},/-]", " ")
    return collapse(F.regexp_replace(out, f"^[{BLANK},]+|[{BLANK},]+$", ""))


def normalize_address(address: Column) -> Column:
    return address_of(normalize_text(address))


def address_tokens(normalized: Column) -> Column:
    parts = F.split(F.coalesce(normalized, F.lit("")), f"[{BLANK},;]+")
    return F.filter(F.transform(parts, lambda t: F.btrim(t, F.lit(".-/"))), lambda t: t != "")


def address_numbers(raw: Column) -> Column:
    """Tokens with a digit, of the raw address, in order and with repeats."""
    found = F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit("[a-zA-Z0-9]+(?:[/-][a-zA-Z0-9]+)*"), F.lit(0))
    return F.transform(F.filter(found, lambda t: t.rlike("[0-9]")), lambda t: F.lower(t))


def normalize_country(country: Column) -> Column:
    """Codes of up to three letters in capitals, other names with each word's first letter a capital."""
    trimmed = F.regexp_replace(F.coalesce(country, F.lit("")), f"^[{BLANK}]+|[{BLANK}]+$", "")
    words = F.regexp_extract_all(trimmed, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    title = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")
    return F.when(F.length(trimmed) <= 3, F.upper(trimmed)).otherwise(title)


def strip_web_domain(token: Column) -> Column:
    ending = rf"(?<=.)\.({'|'.join(WEB_ENDINGS)})$"
    return once(F.lower(token), lambda t: F.when(t.contains("."), F.regexp_replace(t, ending, "")).otherwise(t))


def enrich(records: DataFrame) -> DataFrame:
    """records with the eight derived columns; missing record columns count as empty."""
    have = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in records.columns else F.lit("") for c in RECORD}
    rest = [F.col(c) for c in records.columns if c not in have and c not in DERIVED]
    out = records.select(*[v.alias(c) for c, v in have.items()], *rest)
    # One stage for each dependency, so that no expression stands in the plan more than once.
    out = out.withColumns({"_name": strip_latin_diacritics(F.col("business_name")), "_address": strip_latin_diacritics(F.col("business_address"))})
    out = out.withColumns({
        "business_name_normalized": business_name_of(normalize_folded(F.col("_name"))),
        "business_address_normalized": address_of(normalize_folded(F.col("_address"))),
        "address_numbers": address_numbers(F.col("business_address")),
        "postal_code": postal_code(F.col("business_address")),
        "country_normalized": normalize_country(F.col("country")),
    })
    out = out.withColumns({
        "business_name_core": core_name(F.col("business_name_normalized")),
        "business_name_tokens": name_tokens(F.col("business_name_normalized")),
        "address_tokens": address_tokens(F.col("business_address_normalized")),
    })
    return out.select(*have, *rest, *DERIVED)


def is_enriched(df: DataFrame) -> bool:
    return set(DERIVED) <= set(df.columns)


def enriched(df: DataFrame) -> DataFrame:
    return df if is_enriched(df) else enrich(df)

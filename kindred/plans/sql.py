"""The record model in DuckDB's SQL: what the queries' oracles are put together from."""

from __future__ import annotations

from kindred.functions.constants import ADDRESS_NOISE, LEGAL_PREFIXES, LEGAL_SUFFIXES, NAME_NOISE, WEB_ENDINGS
from kindred.sources.testrecords import SOURCES, TRUTH, with_base


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def text(x: str) -> str:
    e = f"lower(strip_accents(coalesce({x}, '')))"
    e = rf"regexp_replace({e}, '\b<(?:null|none)>\b|\b(?:null|none)\b', ' ', 'g')"
    e = rf"regexp_replace(replace({e}, '&', ' and '), '(\s)\+(\s)', '\1 and \2', 'g')"
    e = rf"regexp_replace({e}, '^[^\p{{L}}\p{{N}}_\s]+|[^\p{{L}}\p{{N}}_\s]+$', ' ', 'g')"
    return collapse(e)


def collapse(e: str) -> str:
    return rf"trim(regexp_replace({e}, '\s+', ' ', 'g'))"


def name(normalized: str) -> str:
    e = normalized
    for _ in range(2):
        e = rf"regexp_replace({e}, '\b([a-zA-Z])\.([a-zA-Z])\b', '\1\2', 'g')"
    return collapse(rf"regexp_replace(regexp_replace({e}, '[-_/\\|+]+', ' ', 'g'), '[\p{{P}}\p{{S}}]', ' ', 'g')")


def core(normalized: str) -> str:
    ordered = sorted(set(LEGAL_SUFFIXES), key=lambda s: (-len(s), s))
    ending = "(?:" + "|".join(f"(?: {s.replace('.', chr(92) + '.')})+" for s in ordered) + ")$"
    e = f"list_reduce(list_concat([{normalized}], string_split({normalized}, ' ')), lambda a, w: regexp_replace(a, '{ending}', ''))"
    return f"regexp_replace({e}, '^(?:{'|'.join(LEGAL_PREFIXES)}) (.)', '\\1')"


def address(normalized: str) -> str:
    e = rf"regexp_replace({normalized}, '[''\"`’‘\[\](){{}}<>#@~*^$]', ' ', 'g')"
    e = rf"regexp_replace({e}, '\s*,\s*', ', ', 'g')"
    e = rf"regexp_replace({e}, '(?:,\s*)+,', ',', 'g')"
    e = rf"regexp_replace(regexp_replace({e}, '(^|[^a-zA-Z0-9])-', '\1 ', 'g'), '-([^a-zA-Z0-9]|$)', ' \1', 'g')"
    e = rf"regexp_replace({e}, '[^\p{{L}}\p{{N}}_\s,/-]', ' ', 'g')"
    return collapse(rf"regexp_replace({e}, '^[\s,]+|[\s,]+$', '', 'g')")


def tokens(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda t: t <> '')"


def address_tokens(x: str) -> str:
    return rf"list_filter(list_transform(string_split_regex({x}, '[\s,;]+'), lambda t: trim(t, '.-/')), lambda t: t <> '')"


def numbers(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, '[a-zA-Z0-9]+(?:[/-][a-zA-Z0-9]+)*'), lambda t: lower(t)), lambda t: regexp_matches(t, '[0-9]'))"


def country(x: str) -> str:
    title = rf"array_to_string(list_transform(regexp_extract_all(trim({x}), '\p{{L}}+|[^\p{{L}}]+'), lambda w: upper(w[1]) || lower(w[2:])), '')"
    return f"CASE WHEN length(trim({x})) <= 3 THEN upper(trim({x})) ELSE {title} END"


def web(x: str) -> str:
    return rf"regexp_replace(lower({x}), '(.)\.({'|'.join(WEB_ENDINGS)})$', '\1')"


def enriched(source: str) -> list[str]:
    """Names of common table expressions that end in {source}_e, the enriched source."""
    return [
        f"{source}_r AS ({SOURCES[source]})",
        f"{source}_n AS (SELECT *, {name(text('business_name'))} AS nn, {address(text('business_address'))} AS na FROM {source}_r)",
        f"""{source}_e AS (SELECT entity_id, business_name, business_address, country, nn AS business_name_normalized, {core('nn')} AS business_name_core,
            {tokens('nn')} AS business_name_tokens, na AS business_address_normalized, {address_tokens('na')} AS address_tokens,
            {numbers('business_address')} AS address_numbers, regexp_extract(business_address, 'CA ([0-9]{{5}})$', 1) AS postal_code,
            {country('country')} AS country_normalized FROM {source}_n)""",
    ]


def over(final: str, *sources: str, more: list[str] | None = None, truth: bool = False) -> str:
    """A whole statement: base, enriched sources, truth pairs if asked, further expressions, and final."""
    parts = [part for s in sources for part in enriched(s)]
    if truth:
        parts.append(f"truth_r AS ({TRUTH})")
        parts.append("truth_e AS (SELECT DISTINCT source1_entity_id, unnest(list_filter(string_split(matched_entity_ids, ','), lambda i: i <> '')) AS target_entity_id FROM truth_r)")
    return with_base(", " + ", ".join([*parts, *(more or [])]) + " " + final).replace(") , ", "), ", 1)


def keys(side: str, out: str) -> str:
    """id, country, kind, key of an enriched side."""
    noise, common = quoted(NAME_NOISE), quoted(ADDRESS_NOISE)
    run = f"array_to_string(list_transform(list_filter(business_name_tokens, lambda t: t NOT IN ({noise})), lambda t: {web('t')}), '')"
    base = "SELECT entity_id AS id, country_normalized AS country"
    return f"""{out} AS (
      SELECT DISTINCT * FROM (
        {base}, 'token' AS kind, unnest(list_filter(list_transform(business_name_tokens, lambda t: {web('t')}), lambda t: length(t) >= 3 AND t NOT IN ({noise}))) AS key FROM {side}
        UNION ALL {base}, 'token', {run} FROM {side} WHERE length({run}) >= 4
        UNION ALL {base}, 'core', business_name_core FROM {side} WHERE length(business_name_core) >= 3
        UNION ALL {base}, 'postal', lower(postal_code) FROM {side} WHERE postal_code <> ''
        UNION ALL {base}, 'number', address_numbers[1] FROM {side} WHERE len(address_numbers) > 0
        UNION ALL {base}, 'address', unnest(list_filter(list_distinct(address_tokens), lambda t: length(t) >= 4 AND t NOT IN ({common}))) FROM {side}))"""


def pairs(target: str, passes, out: str, max_df: int = 100) -> list[str]:
    """Common table expressions that end in out (source1_entity_id, candidate_entity_id)."""
    k, t = f"{out}_k1", f"{out}_k2"
    met = f"""{out}_met AS (
      SELECT a.id AS i, b.id AS t, a.kind AS kind, x.address_numbers AS n1, y.address_numbers AS n2, x.address_tokens AS w1, y.address_tokens AS w2, x.business_name_tokens AS m1, y.business_name_tokens AS m2
      FROM {k} a JOIN {t} b ON a.country = b.country AND a.kind = b.kind AND a.key = b.key
      JOIN s1_e x ON x.entity_id = a.id JOIN {target}_e y ON y.entity_id = b.id
      WHERE a.kind IN ({quoted(passes)}) AND (a.kind <> 'address' OR (SELECT count(*) FROM {t} c WHERE c.kind = 'address' AND c.country = b.country AND c.key = b.key) <= {max_df}))"""
    two = "len(list_intersect(list_distinct(w1), list_distinct(w2))) >= 2"
    return [
        keys("s1_e", k), keys(f"{target}_e", t), met,
        f"""{out} AS (SELECT i AS source1_entity_id, t AS candidate_entity_id FROM (
          SELECT i, t, bool_or(CASE kind WHEN 'token' THEN true WHEN 'core' THEN true WHEN 'postal' THEN list_has_any(n1, n2) OR {two} WHEN 'number' THEN list_has_any(m1, m2) OR {two} ELSE false END) AS direct,
            count(*) FILTER (WHERE kind = 'address') AS words, bool_or(kind = 'address' AND list_has_any(n1, n2)) AS numbered FROM {out}_met GROUP BY i, t) WHERE direct OR numbered OR words >= 2)""",
    ]


def indel(a: str, b: str) -> str:
    lcs = f"""list_last(list_reduce(string_split({a}, ''), lambda row, ch: list_reduce(
        list_transform(range(1, len(row)), lambda j: [CASE WHEN ({b})[j] = ch THEN row[j] + 1 ELSE row[j + 1] END]),
        lambda acc, x: list_append(acc, greatest(acc[len(acc)], x[1])), [0]), list_transform(range(0, length({b}) + 1), lambda z: 0)))"""
    return f"CASE WHEN {a} = {b} THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE 2.0 * {lcs} / (length({a}) + length({b})) END"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct({a}), list_distinct({b})))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


def jaro_winkler(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE jaro_winkler_similarity({a}, {b}) END"


def sorted_tokens(x: str) -> str:
    return f"array_to_string(list_sort(string_split({x}, ' ')), ' ')"


def predictions(pair_table: str, target: str, out: str) -> str:
    return f"""{out} AS (SELECT p.source1_entity_id, p.candidate_entity_id AS target_entity_id,
        round({jaccard('x.business_name_tokens', 'y.business_name_tokens')} * 0.6 + {jaccard('x.address_tokens', 'y.address_tokens')} * 0.3 + (CASE WHEN list_has_any(x.address_numbers, y.address_numbers) THEN 1.0 ELSE 0.0 END) * 0.1, 4) AS prediction_probability
      FROM {pair_table} p JOIN s1_e x ON x.entity_id = p.source1_entity_id JOIN {target}_e y ON y.entity_id = p.candidate_entity_id)"""


def scores(n_true: str, n_predicted: str, n_hit: str) -> str:
    none = f"{n_true} = 0 AND {n_predicted} = 0"
    p = f"(CASE WHEN {none} THEN 1.0 WHEN {n_predicted} = 0 THEN 0.0 ELSE {n_hit}::DOUBLE / {n_predicted} END)"
    r = f"(CASE WHEN {none} THEN 1.0 WHEN {n_true} = 0 THEN 0.0 ELSE {n_hit}::DOUBLE / {n_true} END)"
    return f"{p} AS precision, {r} AS recall, (CASE WHEN {none} THEN 1.0 WHEN {n_hit} = 0 THEN 0.0 ELSE 1.25 * {p} * {r} / (0.25 * {p} + {r}) END) AS f05"

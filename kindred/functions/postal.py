"""Postal codes in free-form addresses: one regular expression a rule, tried in order, inside the JVM.

What a rule asks of the text around a code is a look-around of its expression. Most rules refuse a number
that reads like a street, unit or phone number: one behind a unit word, one that begins an address which
goes on, and one with a street word among the next five words. The rules are:

1. ZIP+4; 2. a code behind a label (pin code, postal code, zip, as a word of its own), of any shape,
not refused for its neighbours; 3. Canadian; 4. British; 5. six digits behind a dash or comma, or at the end, or before the
country; 6. five digits behind a state, comma or dash, at the end, before the country or before a plain
word; 7. five digits at the very end behind two letters, a comma or a dash. Rules 1 to 4 look at the first
number of their shape only, the others at all. Blanks between a code and what a rule looks at behind it
may be 99 at most.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions.constants import STREET_WORDS, UNIT_WORDS
from kindred.functions.once import once

BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"
SOLID = r"[^\s\x1c-\x1f\x85\p{Z}]"
LEFT, RIGHT = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
EDGE = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"

# The shapes of codes and the labels before them.
ZIP, ZIP4, PIN = "[0-9]{5}", "[0-9]{5}-[0-9]{4}", "[1-9][0-9]{5}"
CANADIAN = "[A-Za-z][0-9][A-Za-z][ -]?[0-9][A-Za-z][0-9]"
BRITISH = rf"[A-Z]{{1,2}}[0-9][A-Z0-9]?{BLANK}+[0-9][A-Z]{{2}}"
LOOSE_BRITISH = rf"[A-Za-z]{{1,2}}[0-9][A-Za-z0-9]?{BLANK}*[0-9][A-Za-z]{{2}}"
LABELS = rf"pin{BLANK}*code|pincode|pin|postal{BLANK}*code|postal|zip{BLANK}*code|zipcode|zip"


def _any(words: list[str]) -> str:
    return "|".join(sorted({re.escape(w) for w in words}, key=lambda w: (-len(w), w)))


#: In front of a code: no unit word, and not the beginning of an address that goes on behind the code.
_NO_UNIT = rf"(?<!(?:^|[^a-zA-Z0-9.])(?i:{_any([w.rstrip('.') for w in UNIT_WORDS])})\.{{0,9}}[^a-zA-Z0-9.]{{0,99}})"
_NOT_FIRST = rf"(?:(?<!^[\s#,-]{{0,99}})|(?=%s{BLANK}*$))"
#: Behind it: none of the next five words is a street word.
_PUNCTUATION = r"[.,;:\-()\[\]]*"
_NO_STREET = rf"(?!{BLANK}*(?:{SOLID}+{BLANK}+){{0,4}}{_PUNCTUATION}(?i:{_any(STREET_WORDS)}){_PUNCTUATION}(?:{BLANK}|$))"


def _guarded(code: str, before: str = "", after: str = "") -> str:
    # The code and what must follow it are looked for first: look-behinds, which try every length, run only where these stand.
    return f"(?={code}{after})" + before + _NO_UNIT + _NOT_FIRST.replace("%s", code) + f"({code})" + _NO_STREET + after


def _first(code: str) -> str:
    """Only the first place of the shape counts: the search for it is not taken back."""
    return rf"(?s)^(?>.*?(?={LEFT}{code}{RIGHT}))" + _guarded(code, after=RIGHT)


def _country(names: str) -> str:
    return rf"(?={BLANK}*,?{BLANK}*(?i:{names})?$)"


_PIN = _guarded(PIN, before=LEFT, after=RIGHT + rf"(?:(?<=[-,]{BLANK}{{0,99}}[0-9]{{6}})|{_country('India|IN|Bharat')})")
_ZIP_INSIDE = _guarded(
    rf"(?!00){ZIP}",
    before=rf"{LEFT}(?<=(?:{LEFT}[A-Z]{{2}}{BLANK}{{1,99}}|[-,]{BLANK}{{0,99}}))",
    after=RIGHT + rf"(?:{_country('USA?|United States|US')}|(?={BLANK}*[.,;]*\p{{L}}+[.,;]*(?:{BLANK}|$)))",
)
_ZIP_LAST = _guarded(rf"(?!00){ZIP}", before=rf"(?<=(?:[A-Za-z]{{2}}|[-,]){BLANK}{{0,99}})", after="$")
#: No code begins with three letters, so a word that goes on with them is no label, though it begins like one.
_LABELLED = rf"(?i){LEFT}(?:{LABELS})(?!\p{{L}}{{3}}){BLANK}*[:#-]?{BLANK}*([A-Za-z0-9\s-]{{3,10}}){EDGE}"


def postal_code(address: Column) -> Column:
    """The address's postal code, empty if there is none."""
    return once(F.regexp_replace(F.coalesce(address, F.lit("")), rf"^{BLANK}+|{BLANK}+$", ""), _code)


def _code(text: Column) -> Column:
    """The code of a text without blanks at its ends."""
    found = lambda pattern: F.regexp_extract(text, pattern, 1)
    compact = lambda code: F.upper(F.replace(code, F.lit(" "), F.lit("")))

    def code_of(label: Column) -> Column:
        return (
            F.when(label.rlike(f"^(?:{ZIP}(?:-[0-9]{{4}})?|{PIN})$"), label)
            .when(label.rlike(f"^{CANADIAN}$"), compact(label))
            .when(label.rlike(f"^{LOOSE_BRITISH}$"), F.upper(label))
            .otherwise("")
        )

    labelled = once(F.trim(F.regexp_replace(found(_LABELLED), BLANK, " ")), code_of)
    rules = [found(_first(ZIP4)), labelled, compact(found(_first(CANADIAN))), F.upper(found(_first(BRITISH))), found(_PIN), found(_ZIP_INSIDE), found(_ZIP_LAST)]
    return F.coalesce(*[once(code, lambda c: F.when(c != "", c)) for code in rules], F.lit(""))

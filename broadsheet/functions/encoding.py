"""Percent-encoding and dot segments of URLs in the normal form of RFC 3986.

Bytes that needn't be encoded are not, all others are, in capitals. What stands for a reserved character
stays encoded, since it means something else than the character itself, as does what is no text in
UTF-8. A percent sign without two digits behind it is left alone, and so are triplets right behind it that
would complete it; so doing it all again changes nothing. A URL is taken apart into triplets, whole
encoded characters and stretches of others by one pattern, and each part is looked at by itself.
"""

from __future__ import annotations

import string

from broadsheet.plans.dialect import Form

# ---- fixed values: RFC 3986, 2.2 and 2.3, the bytes of UTF-8, and 5.2.4 ----
_UNRESERVED = "A-Za-z0-9._~-"
_RESERVED = r":/?#\[\]@!$&\x27()*+,;="
_H = "[0-9A-Fa-f]"
_NEXT = "%[89ABab]" + _H
_SEQUENCES = f"%[CDcd]{_H}{_NEXT}|%[Ee]{_H}(?:{_NEXT}){{2}}|%[Ff][0-7](?:{_NEXT}){{3}}"
# ---- end of fixed values ----
_TRIPLET = f"%{_H}{{2}}"
#: A whole character; a byte; a lone percent sign and the triplet that must not complete it; anything else.
_ENCODED = f"{_SEQUENCES}|{_TRIPLET}|%{_H}?{_TRIPLET}|[^%]+|%"
#: Decoded, these would end a line for a pattern that comes later.
_LINE_ENDS = r"\x{85}\x{2028}\x{2029}\n\r"


def _capitals(t: str, last: str) -> str:
    """SQL for a part whose last triplet is in capitals."""
    return f"concat(left({t}, CAST(length({t}) - 3 AS INT)), upper({last}))"


def decoded() -> Form:
    """Characters that are encoded needlessly, and those beyond ASCII, as themselves."""
    plain = f"^[{_UNRESERVED}]$"

    def part(t: str, text: str, test: str, valid: str, length: str, last: str) -> str:
        as_text = f"CASE WHEN {length} = 3 THEN CASE WHEN {test.format(text, plain)} THEN {text} ELSE upper({t}) END WHEN {valid} AND NOT ({test.format(text, f'[{_LINE_ENDS}]')}) THEN {text} ELSE upper({t}) END"
        return f"CASE WHEN left({t}, 1) <> '%' OR {length} = 1 THEN {t} WHEN {length} IN (4, 5) THEN {_capitals(t, last)} ELSE {as_text} END"

    bytes_of = "replace(t, '%', '')"
    spark = part("t", "b", "{0} RLIKE r'{1}'", "is_valid_utf8(b)", "length(t)", "right(t, 3)")
    duck = part("t", "b", "regexp_matches({0}, '{1}')", "b IS NOT NULL", "length(t)", "right(t, 3)")
    return Form(
        f"x -> CASE WHEN contains(x, '%') THEN array_join(transform(regexp_extract_all(x, r'{_ENCODED}', 0), t -> transform(array(IF(t RLIKE r'^(?:{_TRIPLET})+$', CAST(unhex({bytes_of}) AS STRING), '')), b -> {spark})[0]), '') ELSE x END",
        f"lambda x: CASE WHEN contains(x, '%') THEN array_to_string(list_transform(regexp_extract_all(x, '{_ENCODED}'), lambda t: list_transform([CASE WHEN regexp_full_match(t, '(?:{_TRIPLET})+') THEN TRY(decode(unhex({bytes_of}))) ELSE '' END], lambda b: {duck})[1]), '') ELSE x END",
    )


def encoded() -> Form:
    """What may not stand in a URL behind its host, encoded, and all triplets in capitals."""
    # one by one, as Java looks up single letters of a class in a table but tries its ranges in turn
    allowed = string.ascii_letters + string.digits + "._~" + _RESERVED + "-"
    in_hex = "regexp_replace(hex(t), '(..)', {0})"
    odd, parts = f"[^{allowed}]", rf"{_TRIPLET}|[{allowed}]+|%|[^%{allowed}]+"
    where = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)((?s:.*))\z"

    def part(test: str, by: str) -> str:
        return f"CASE WHEN {test.format(f'^{_TRIPLET}$')} THEN upper(t) WHEN t = '%' OR {test.format(f'^[{allowed}]')} THEN t ELSE {in_hex.format(by)} END"

    spark = part("t RLIKE r'{0}'", "'%$1'")
    duck = part("regexp_matches(t, '{0}')", r"'%\1', 'g'")
    return Form(
        f"x -> CASE WHEN x RLIKE r'{odd}' AND x RLIKE r'{where}' THEN concat(regexp_extract(x, r'{where}', 1), array_join(transform(regexp_extract_all(regexp_extract(x, r'{where}', 2), r'{parts}', 0), t -> {spark}), '')) ELSE x END",
        f"lambda x: CASE WHEN regexp_matches(x, '{odd}') AND regexp_matches(x, '{where}') THEN regexp_extract(x, '{where}', 1) || array_to_string(list_transform(regexp_extract_all(regexp_extract(x, '{where}', 2), '{parts}'), lambda t: {duck}), '') ELSE x END",
    )


_SPLIT = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)([^?#]*)((?s:.*))\z"
_DOTS = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/(?:[^?#]*/)?[.][.]?(?:[/?#]|\z)"


def without_dots() -> Form:
    """Paths without segments of one or two dots: one is passed over, two take the segment before them away, but nothing above the first."""
    part = lambda i: f"regexp_extract(x, r'{_SPLIT}', {i})"
    fold = "(a, p) -> CASE WHEN p = '.' THEN a WHEN p <> '..' THEN array_append(a, p) WHEN size(a) > 1 THEN slice(a, 1, size(a) - 1) ELSE a END"
    # a path that ends in dots ends in the directory that they lead to
    whole = f"transform(array({part(2)}), y -> aggregate(split(IF(y RLIKE r'/[.][.]?\\z', concat(y, '/'), y), '/'), CAST(array() AS ARRAY<STRING>), {fold}, a -> array_join(a, '/')))[0]"
    duck_part = lambda i: part(i).replace("r'", "'")
    duck_fold = "lambda a, p: CASE WHEN p[1] = '.' THEN a WHEN p[1] <> '..' THEN list_append(a, p[1]) WHEN len(a) > 1 THEN a[1:len(a) - 1] ELSE a END"
    duck_whole = f"array_to_string(list_reduce(list_transform(string_split(regexp_replace({duck_part(2)}, '(/[.][.]?)\\z', '\\1/'), '/'), lambda p: [p]), {duck_fold}, [] :: VARCHAR[]), '/')"
    return Form(
        f"x -> CASE WHEN x RLIKE r'{_DOTS}' THEN concat({part(1)}, {whole}, {part(3)}) ELSE x END",
        f"lambda x: CASE WHEN regexp_matches(x, '{_DOTS}') THEN {duck_part(1)} || {duck_whole} || {duck_part(3)} ELSE x END",
    )

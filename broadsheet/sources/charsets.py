"""The character set of a body of bytes, found in the bytes.

Sets of several bytes a character are told by state machines, as patterns over bytes that the whole body
must match, and among those that it matches by how many of its characters lie where the frequent ones of
that set do. Sets of one byte are told by frequency tables: what letters the bytes would be, how common
those are, and whether they would stand together in words. The whole body counts, but only the words that
have bytes beyond ASCII.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values: marks of byte order, how the sets are made up, and letters by how common they are ----
_MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
#: Of each set of several bytes: one character beyond ASCII, and a frequent one.
_MULTI = {
    "shift_jis": (rb"[\xa1-\xdf]|[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc]", rb"\x81[\x40-\x5b\x69\x6a\x75\x76]|\x82[\x9f-\xf1]|\x83[\x40-\x96]|[\x88-\x97][\x40-\x7e\x80-\xfc]"),
    "euc_jp": (rb"\x8e[\xa1-\xdf]|\x8f[\xa1-\xfe]{2}|[\xa1-\xfe]{2}", rb"\xa1[\xa1-\xbc\xca\xcb\xd6\xd7]|[\xa4\xa5][\xa1-\xf6]|[\xb0-\xcf][\xa1-\xfe]"),
    "gb18030": (rb"[\x81-\xfe][\x40-\x7e\x80-\xfe]|(?:[\x81-\xfe][0-9]){2}", rb"\xa1[\xa1-\xbf]|\xa3[\xa1-\xfe]|[\xb0-\xd7][\xa1-\xfe]"),
    "big5": (rb"[\xa1-\xf9][\x40-\x7e\xa1-\xfe]", rb"\xa1[\x40-\x7e\xa1-\xb0]|[\xa4-\xc6][\x40-\x7e\xa1-\xfe]"),
    "euc_kr": (rb"[\xa1-\xfe]{2}", rb"\xa1[\xa1-\xbf]|[\xb0-\xc8][\xa1-\xfe]"),
}
#: What one of those sets has much of and the others have not: kana, low second bytes, no characters behind the Korean ones.
_KANA = {"shift_jis": rb"\x82[\x9f-\xf1]|\x83[\x40-\x96]", "euc_jp": rb"[\xa4\xa5][\xa1-\xf6]"}
_LOW_SECOND, _BEHIND_KOREAN = rb"[\x81-\xfe][\x40-\x7e]", rb"[\xc9-\xfe][\xa1-\xfe]"
_CYRILLIC = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъёіїєґў"
_SINGLE = {
    "windows-1252": "éóüäáíñöàçèßêúîâôëïûùãõåøæœìò",
    "windows-1250": "éáíóąęłśżćńźěščřžýůúöüőűďťňäßăâîţş",
    "windows-1251": _CYRILLIC,
    "koi8-r": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё",
    "iso8859-5": _CYRILLIC,
    "windows-1253": "αοιετσνηυρπκμλςωδγίόάέήύχθφώβξζψϊϋ",
    "windows-1254": "ışğüöçâîû",
    "windows-1255": "יוהלאמרתשבנדכעםחקפטגסזצןךףץ",
}
_PUNCTUATION = "’‘“”„–—…«»°©®€·•№ §¿¡ºª"
# ---- end of fixed values ----
_ESCAPES = re.compile(rb"\x1b\$[@B]|\x1b\([BJ]")
_HIGH = re.compile(rb"[\x80-\xff]")
_WORDS = re.compile(rb"[A-Za-z\x80-\xff]*[\x80-\xff][A-Za-z\x80-\xff]*")
_MACHINES = {name: re.compile(rb"(?:[\x00-\x7f]|" + one + rb")*+") for name, (one, _) in _MULTI.items()}
_ONE = {name: re.compile(one) for name, (one, _) in _MULTI.items()}
_FREQUENT = {name: re.compile(often) for name, (_, often) in _MULTI.items()}
_KANA_MACHINES = {name: re.compile(one) for name, one in _KANA.items()}
_LOW, _BEHIND = re.compile(_LOW_SECOND), re.compile(_BEHIND_KOREAN)
#: Share of frequent characters below which a body is not in a set of several bytes, and of kana in Japanese.
_ENOUGH, _KANA_ENOUGH = 0.6, 0.15
#: Zero bytes of every other place that make a text of two bytes a character.
_ZEROS = 0.4


def _is_utf8(body: bytes) -> bool:
    """Whether a body is text in UTF-8, but for a character that its end breaks off, if it has whole ones beyond ASCII before."""
    try:
        body.decode("utf-8")
    except UnicodeDecodeError as e:
        return e.reason == "unexpected end of data" and _HIGH.search(body, 0, e.start) is not None
    return True


def _multi_score(name: str, body: bytes) -> float:
    """How much a body looks like text in a set of several bytes a character; 0 if it can't be any."""
    end = _MACHINES[name].match(body).end()
    if end < len(body) - 1:  # the last character may be broken off
        return 0.0
    seen = Counter(c for c in _ONE[name].findall(body) if len(c) > 1)
    total = sum(seen.values())
    if not total:
        return 0.0
    share = lambda pattern: sum(n for c, n in seen.items() if pattern.fullmatch(c)) / total
    score = share(_FREQUENT[name])
    if name in _KANA_MACHINES:
        kana = share(_KANA_MACHINES[name])
        return score + kana if kana >= _KANA_ENOUGH else 0.0
    if name == "big5":
        return score + 0.1 if share(_LOW) > 0.15 else score / 2
    if name == "euc_kr":
        return score + 0.1 if share(_BEHIND) < 0.05 else score / 2
    return score


def _worth(name: str) -> dict[str, float]:
    """What each letter of a set counts for: 1 for the most common, half for the least, less for capitals."""
    letters = _SINGLE[name]
    worth = {c: 1 - k / len(letters) / 2 for k, c in enumerate(letters)}
    return {c: 0.3 for c in _PUNCTUATION} | {c.upper(): 0.4 * v for c, v in worth.items() if len(c.upper()) == 1} | worth


_WORTH = {name: _worth(name) for name in _SINGLE}


def _script(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0] if c.isalpha() else ""


def _word_score(name: str, word: bytes) -> float:
    """What a word's letters are worth, less for what words don't have: other scripts' letters, capitals inside, accents in a row."""
    text, worth, score = word.decode(name, "replace"), _WORTH[name], 0.0
    for k, c in enumerate(text):
        if c.isascii():
            continue
        before = text[k - 1] if k else ""
        score += worth.get(c, -0.5 if c.isalpha() else -3.0 if c == "�" or unicodedata.category(c) == "Cc" else -0.2)
        if before and before.isalpha() and c.isalpha():
            score -= before.islower() and c.isupper()
            score -= _script(before) != _script(c)
            score -= _script(c) == "LATIN" and not before.isascii()
        if k + 1 < len(text) and text[k + 1].isascii() and _script(c) not in ("", "LATIN"):
            score -= 1
    return score


def detect(body: bytes) -> str:
    """The name of the character set; windows-1252 where nothing is likelier. ascii for an empty body."""
    for mark, name in _MARKS:
        if body.startswith(mark):
            return name
    if not _HIGH.search(body):
        if len(body) >= 4 and b"\x00" in body:
            for name, odd in (("utf-16-be", 0), ("utf-16-le", 1)):
                if body[odd::2].count(0) > _ZEROS * len(body[odd::2]):
                    return name
        return "iso2022_jp" if _ESCAPES.search(body) else "ascii"
    for name, odd in (("utf-16-be", 0), ("utf-16-le", 1)):
        if body[odd::2].count(0) > _ZEROS * len(body) / 2 and body[1 - odd :: 2].count(0) == 0:
            return name
    if _is_utf8(body):
        return "utf-8"
    score, best = max((_multi_score(name, body), name) for name in _MULTI)
    if score >= _ENOUGH:
        return best
    words = Counter(_WORDS.findall(body))
    scores = {name: sum(n * _word_score(name, w) for w, n in words.items()) for name in _SINGLE}
    return max(scores, key=lambda name: scores[name])


def decoded(body: bytes | None, declared: str | None) -> tuple[str | None, str | None]:
    """(text, character set) of a body. A declared UTF-8 is trusted; any other declaration is not, as many are wrong."""
    if body is None:
        return None, None
    name = "utf-8" if (declared or "").strip().strip("\"'").lower() in ("utf-8", "utf8") else detect(body)
    text = body.decode(name, "replace")
    return text.removeprefix("﻿"), name


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("html", "charset")]))
def decode_bodies(bodies: pd.Series, declared: pd.Series) -> pd.DataFrame:
    """decoded() of each row."""
    rows = [decoded(None if b is None else bytes(b), None if pd.isna(d) else d) for b, d in zip(bodies, declared, strict=True)]
    return pd.DataFrame(rows, columns=["html", "charset"], dtype=object)


def decode(body: Column, declared: Column) -> Column:
    """html and charset of a body, as a struct. Text in UTF-8 is left to the JVM; of it no byte goes to Python.

    A null body has neither. What is declared but null or not known counts as not declared.
    """
    text = F.make_valid_utf8(body.cast("string"))
    said = F.coalesce(F.lower(F.regexp_replace(declared, "[\"' ]", "")).isin("utf-8", "utf8"), F.lit(False))
    # text of two bytes a character may look like ASCII with zeros between, and escapes like ASCII too
    odd = F.contains(text, F.lit("\x00")) | F.contains(text, F.lit("\x1b$"))
    here = body.isNull() | said | (F.is_valid_utf8(body.cast("string")) & ~odd)
    found = decode_bodies(F.when(~here, body), F.when(~here, declared))
    name = F.when(body.isNull(), None).when(said | (F.length(body) > F.length(text)), "utf-8").otherwise("ascii")
    return F.when(here, F.struct(F.regexp_replace(text, "^\ufeff", "").alias("html"), name.alias("charset"))).otherwise(found)

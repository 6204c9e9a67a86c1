"""International hosts: labels of any letters to their form in ASCII and back, by Bootstring (RFC 3492).

Both ways are folds of Spark's SQL over the code points of a label, and so stay in the JVM. Hosts in ASCII
are left alone by one test. A label's letters are lower-cased and composed first: what is written as a
letter and a mark, as file systems do, counts as the one letter that it stands for.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.plans.dialect import Form

# ---- fixed values: the parameters of RFC 3492, section 5, and the full stops that part labels ----
_BASE, _T_MIN, _T_MAX, _SKEW, _DAMP, _BIAS, _FIRST = 36, 1, 26, 38, 700, 72, 128
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
_STOPS = "。．｡"
_PREFIX = "xn--"
# ---- end of fixed values ----
#: Digits of a number at most; more stand for code points that there are not.
_LONGEST = 9
_GREATEST = 0x10FFFF


def _adapted(delta: str, points: str, first: str) -> str:
    """SQL for the bias after a number."""
    start = f"IF({first}, {delta} DIV {_DAMP}, {delta} DIV 2)"
    shrunk = f"transform(array({start}), d0 -> d0 + d0 DIV {points})[0]"
    limit = (_BASE - _T_MIN) * _T_MAX // 2
    step = f"(w, j) -> IF(w.d > {limit}, named_struct('d', w.d DIV {_BASE - _T_MIN}, 'k', w.k + {_BASE}), w)"
    return f"aggregate(sequence(1, {_LONGEST}), named_struct('d', {shrunk}, 'k', 0L), {step}, w -> w.k + ({_BASE - _T_MIN + 1} * w.d) DIV (w.d + {_SKEW}))"


def _threshold(k: str, bias: str) -> str:
    return f"least(greatest({k} - {bias}, {_T_MIN}L), {_T_MAX}L)"


def _number(delta: str, bias: str) -> str:
    """SQL for a number in digits that grow in weight, the last of which is below its threshold."""
    digit = lambda v: f"substring('{_DIGITS}', CAST({v} AS INT) + 1, 1)"
    more = f"named_struct('q', (v.q - t) DIV ({_BASE} - t), 'out', concat(v.out, {digit(f't + (v.q - t) % ({_BASE} - t)')}), 'done', false)"
    last = f"named_struct('q', v.q, 'out', concat(v.out, {digit('v.q')}), 'done', true)"
    step = f"(v, k) -> IF(v.done, v, transform(array({_threshold(f'{_BASE}L * k', bias)}), t -> IF(v.q < t, {last}, {more}))[0])"
    return f"aggregate(sequence(1, {_LONGEST}), named_struct('q', {delta}, 'out', '', 'done', false), {step}, v -> v.out)"


def _encoded(label: str) -> str:
    """SQL for a label's Bootstring form. Letters are put in by code point and then place, each as the steps from the one before."""
    place = "CAST(size(filter(c, (x, j) -> j < s.at AND x <= s.cp)) AS BIGINT)"
    delta = "(s.cp - a.n) * (a.h + 1) + p - a.i"
    put = f"named_struct('h', a.h + 1, 'n', s.cp, 'i', p + 1, 'bias', {_adapted('d', '(a.h + 1)', 'a.h = a.b')}, 'b', a.b, 'out', concat(a.out, {_number('d', 'a.bias')}))"
    step = f"(a, s) -> transform(array({place}), p -> transform(array({delta}), d -> {put})[0])[0]"
    todo = "array_sort(filter(transform(c, (x, i) -> named_struct('cp', x, 'at', i)), s -> s.cp >= 128))"
    basic = "CAST(size(filter(c, x -> x < 128)) AS BIGINT)"
    ascii_ = f"regexp_replace({label}, '[^\\\\x00-\\\\x7f]', '')"
    start = f"named_struct('h', {basic}, 'n', {_FIRST}L, 'i', 0L, 'bias', {_BIAS}L, 'b', {basic}, 'out', IF({ascii_} = '', '', concat({ascii_}, '-')))"
    points = f"transform(split({label}, ''), ch -> CAST(ascii(ch) AS BIGINT))"
    return f"transform(array({points}), c -> aggregate({todo}, {start}, {step}, a -> a.out))[0]"


def _char(point: str) -> str:
    return f"decode(unhex(lpad(hex({point}), 8, '0')), 'UTF-32')"


def _decoded(form: str) -> str:
    """SQL for the label that a Bootstring form stands for; null for none. A digit moves on, the last of a number puts in a letter."""
    value = f"instr('{_DIGITS}', g) - 1L"
    put_at = "concat(slice(a.out, 1, CAST(at AS INT)), array(n2), slice(a.out, CAST(at AS INT) + 1, size(a.out)))"
    put = f"named_struct('out', {put_at}, 'n', n2, 'i', at + 1, 'old', at + 1, 'w', 1L, 'k', {_BASE}L, 'bias', {_adapted('(i2 - a.old)', '(size(a.out) + 1L)', 'a.old = 0')}, 'ok', n2 <= {_GREATEST} AND (n2 < 55296 OR n2 > 57343))"
    last = f"transform(array(a.n + i2 DIV (size(a.out) + 1L)), n2 -> transform(array(i2 % (size(a.out) + 1L)), at -> {put})[0])[0]"
    more = f"named_struct('out', a.out, 'n', a.n, 'i', i2, 'old', a.old, 'w', a.w * ({_BASE} - t), 'k', a.k + {_BASE}, 'bias', a.bias, 'ok', a.w < 1L << 32)"
    bad = "named_struct('out', a.out, 'n', a.n, 'i', a.i, 'old', a.old, 'w', a.w, 'k', a.k, 'bias', a.bias, 'ok', false)"
    step = f"(a, g) -> IF(NOT a.ok, a, transform(array({value}), v -> IF(v < 0, {bad}, transform(array(a.i + v * a.w), i2 -> transform(array({_threshold('a.k', 'a.bias')}), t -> IF(v < t, {last}, {more}))[0])[0]))[0])"
    basic = f"regexp_extract({form}, '^(.*)-[^-]*$', 1)"
    digits = f"filter(split(regexp_extract({form}, '([^-]*)$', 1), ''), ch -> ch <> '')"
    known = f"transform(filter(split({basic}, ''), ch -> ch <> ''), ch -> CAST(ascii(ch) AS BIGINT))"
    start = f"named_struct('out', {known}, 'n', {_FIRST}L, 'i', 0L, 'old', 0L, 'w', 1L, 'k', {_BASE}L, 'bias', {_BIAS}L, 'ok', true)"
    done = f"a -> IF(a.ok AND a.w = 1 AND size(a.out) > 0, array_join(transform(a.out, o -> {_char('o')}), ''), NULL)"
    return f"aggregate({digits}, {start}, {step}, {done})"


@functools.lru_cache(1)
def _compositions() -> str:
    """Every pair of characters that Unicode composes and what it makes of them, end to end, each after a separator."""
    pairs = []
    for point in range(0xC0, _GREATEST + 1):
        parts = unicodedata.decomposition(chr(point)).split(" ")
        if len(parts) == 2 and "<" not in parts[0]:
            pair = "".join(chr(int(p, 16)) for p in parts)
            if unicodedata.normalize("NFC", pair) == chr(point):
                pairs.append(f"\x01{pair}{chr(point)}")
    return "".join(pairs)


def _composed(label: str) -> str:
    """SQL for a label whose marks, in the order that Unicode gives them, are made one with their letters, and Korean parts with each other."""
    pair = "instr(known, concat('\\u0001', a.last, ch))"
    korean = "ascii(a.last) BETWEEN 4352 AND 4370 AND ascii(ch) BETWEEN 4449 AND 4469"
    korean_end = "ascii(a.last) BETWEEN 44032 AND 55203 AND (ascii(a.last) - 44032) % 28 = 0 AND ascii(ch) BETWEEN 4520 AND 4546"
    syllable = _char("44032 + ((ascii(a.last) - 4352) * 21 + ascii(ch) - 4449) * 28")
    closed = _char("ascii(a.last) + ascii(ch) - 4519")
    joined = f"CASE WHEN a.last = '' THEN NULL WHEN {korean} THEN {syllable} WHEN {korean_end} THEN {closed} WHEN {pair} > 0 THEN substring(known, {pair} + 3, 1) END"
    # a mark that joins nothing waits behind its letter, so that the next one may still join
    step = f"(a, ch) -> transform(array({joined}), j -> CASE WHEN j IS NOT NULL THEN named_struct('out', a.out, 'last', j, 'marks', a.marks) WHEN ch RLIKE '^\\\\p{{M}}' AND a.last <> '' THEN named_struct('out', a.out, 'last', a.last, 'marks', concat(a.marks, ch)) ELSE named_struct('out', concat(a.out, a.last, a.marks), 'last', ch, 'marks', '') END)[0]"
    fold = f"aggregate(split({label}, ''), named_struct('out', '', 'last', '', 'marks', ''), {step}, a -> concat(a.out, a.last, a.marks))"
    return f"CASE WHEN {label} RLIKE '[\\\\p{{M}}\\\\u1161-\\\\u11c2]' THEN transform(array('{_compositions()}'), known -> {fold})[0] ELSE {label} END"


@functools.lru_cache(1)
def ascii_form() -> Form:
    """A host with every label in ASCII, lower-cased; a host in ASCII stays as it is."""
    label = f"transform(array({_composed('l')}), m -> IF(m RLIKE '^[\\\\x00-\\\\x7f]*$', m, concat('{_PREFIX}', {_encoded('m')})))[0]"
    stops = "[" + _STOPS + "]"
    return Form(f"x -> CASE WHEN x RLIKE '[^\\\\x00-\\\\x7f]' THEN array_join(transform(split(lower(regexp_replace(x, '{stops}', '.')), '[.]'), l -> {label}), '.') ELSE x END")


@functools.lru_cache(1)
def unicode_form() -> Form:
    """A host with the letters that its labels stand for; a label that stands for none stays."""
    label = f"IF(startswith(l, '{_PREFIX}'), coalesce(transform(array(substring(l, {len(_PREFIX) + 1})), f -> {_decoded('f')})[0], l), l)"
    return Form(f"x -> CASE WHEN contains(lower(x), '{_PREFIX}') THEN array_join(transform(split(lower(x), '[.]'), l -> {label}), '.') ELSE x END")


def to_ascii(host: Column) -> Column:
    """ascii_form() as a column; null for null."""
    return F.call_function("transform", F.array(host), F.expr(ascii_form().spark))[0]


def to_unicode(host: Column) -> Column:
    """unicode_form() as a column; null for null."""
    return F.call_function("transform", F.array(host), F.expr(unicode_form().spark))[0]

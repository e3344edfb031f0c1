"""Addresses of both versions: cleaning, keys that order like the addresses, bounds of blocks.

The expressions are built as SQL text, from and to text, and only become a Column at the end: one call for each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4]\\d|[01]?\\d?\\d)"
V4 = rf"{_OCTET}(?:\\.{_OCTET}){{3}}"


def _let(value: str, name: str, body: str) -> str:
    """SQL: the body, where the name stands for the value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _number(ip: str) -> str:
    return " + ".join(f"try_cast(split_part({ip}, '.', {i + 1}) as bigint) * {256 ** (3 - i)}" for i in range(4))


def _digits6(ip: str) -> str:
    """SQL: the 32 hexadecimal digits of an IPv6 address (zone left out, an IPv4 tail is fine); null if it is none."""
    digits = lambda gs: f"array_join(transform({gs}, g -> lpad(g, 4, '0')), '')"
    group = lambda i: f"filter(split(coalesce(get(h6, {i}), ''), ':'), g -> g <> '')"
    n = "(size(a6) + size(b6))"
    fits = f"if(size(h6) = 2, {n} <= 7, size(h6) = 1 and {n} = 8) and forall(concat(a6, b6), g -> g rlike '^[0-9a-f]{{1,4}}$')"
    joined = f"if({fits}, concat({digits('a6')}, repeat('0000', greatest(8 - {n}, 0)), {digits('b6')}), null)"
    halves = _let(group(0), "a6", _let(group(1), "b6", joined))
    tail = rf"regexp_extract(l6, ':({V4})$', 1)"
    hexed = _let(f"lpad(lower(hex({_number('t6')})), 8, '0')", "x6", "concat(regexp_replace(l6, '[^:]*$', ''), substring(x6, 1, 4), ':', substring(x6, 5, 4))")
    plain = _let(tail, "t6", f"if(t6 <> '', {hexed}, l6)")
    good = _let(plain, "p6", f"if(p6 rlike ':::|^:[^:]|[^:]:$|^:$', null, {_let('split(p6, \'::\')', 'h6', halves)})")
    return f"if(instr({ip}, ':') > 0, {_let(f'lower(regexp_replace({ip}, \'%.*$\', \'\'))', 'l6', good)}, null)"


def _key(ip: str) -> str:
    return f"if(instr({ip}, ':') > 0, concat('6', {_digits6(ip)}), concat('4', lpad(lower(hex({_number(ip)})), 32, '0')))"


def ipv6_digits(ip: str) -> Column:
    return F.expr(_digits6(ip))


def first_address(raw: str) -> Column:
    """First valid address of a list, without brackets and port; null if there is none."""
    boxed = r"regexp_extract(t, '^\\[([0-9A-Fa-f:.%]+)\\](?::\\d+)?$', 1)"
    bare = rf"case when {boxed} <> '' then {boxed} when t rlike '^[\\d.]+:\\d+$' then regexp_replace(t, ':\\d+$', '') else t end"
    tokens = f"transform(split({raw}, '[,\\\\s\"]+'), t -> {bare})"
    valid = f"t rlike '^{V4}$' or {_digits6('t')} is not null"
    return F.expr(f"case when {raw} rlike '^{V4}$' then {raw} when {raw} is not null then get(filter({tokens}, t -> {valid}), 0) end")


def address_key(ip: str) -> Column:
    """The version and 32 hexadecimal digits: orders like the addresses of a version."""
    return F.expr(_key(ip))


def block_bounds(cidr: str) -> Column:
    """First and last address of a block as keys (struct lo, hi); null for what is no block."""
    good = f"if(instr(i, ':') > 0, {_digits6('i')} is not null and n between 0 and 128, i rlike '^{V4}$' and n between 0 and 32)"
    # k: key; f: bits that are fixed of the 128; w: whole digits of them; d: the digit that is cut; s: how many values it spans.
    head = "substring(k, 1, w + 1)"
    low = "cast(floor(d / s) * s as int)"
    ends = f"if(s = 16, struct(rpad({head}, 33, '0') as lo, rpad({head}, 33, 'f') as hi), struct(rpad(concat({head}, lower(hex({low}))), 33, '0') as lo, rpad(concat({head}, lower(hex({low} + s - 1))), 33, 'f') as hi))"
    cut = _let("cast(floor(f / 4) as int)", "w", _let("cast(power(2, 4 - f % 4) as int)", "s", _let("coalesce(cast(conv(substring(k, w + 2, 1), 16, 10) as int), 0)", "d", ends)))
    body = f"if({good}, {_let(_key('i'), 'k', _let('if(instr(i, \':\') > 0, n, n + 96)', 'f', cut))}, null)"
    return F.expr(_let(f"substring_index(trim({cidr}), '/', 1)", "i", _let(rf"try_cast(regexp_extract({cidr}, '/(\\d{{1,3}})\\s*$', 1) as int)", "n", body)))

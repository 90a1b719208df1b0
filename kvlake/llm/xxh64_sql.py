"""XXH64 in DuckDB SQL, for oracles: 64-bit arithmetic in 128-bit integers."""
from __future__ import annotations

MOD = "'18446744073709551616'::uhugeint"
# The hash's primes.
PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


def number(x: int) -> str:
    return f"'{x % 2**64}'::uhugeint"


def _times(a: str, b: int) -> str:
    return f"(({a}) * {number(b)} % {MOD})"


def _turned(x: str, bits: int) -> str:
    return f"(({x}) * {number(1 << bits)} % {MOD} + ({x}) // {number(1 << (64 - bits))})"


def _let(value: str, use: str) -> str:
    """`use`, where t is the value."""
    return f"list_transform([{value}], lambda t: {use})[1]"


def _word(at: str, size: int) -> str:
    """The little-endian number in `size` bytes of the text whose bytes are spelled in hex as x."""
    return "('0x' || " + " || ".join(f"substr(x, ({at}) * 2 + {2 * k + 1}, 2)" for k in range(size - 1, -1, -1)) + ")::ubigint::uhugeint"


def _fold(start: str, words: str, step: str) -> str:
    return f"list_reduce(list_prepend({start}, {words}), lambda a, w: {step})"


def _round(a: str, w: str) -> str:
    return _let(f"({a} + {_times(w, PRIMES[1])}) % {MOD}", _times(_turned("t", 31), PRIMES[0]))


def tables(source: str, seed: int) -> str:
    """Common table expressions of which the last, `hashed`, has the hash `h` (ubigint) of each text `s` of the table `source`."""
    p1, p2, p3, p4, p5 = PRIMES
    lanes = [_fold(number(first), f"list_transform(range(0, n // 32), lambda k: {_word(f'k * 32 + {8 * i}', 8)})", _round("a", "w")) for i, first in enumerate((seed + p1 + p2, seed + p2, seed, seed - p1))]
    merged = lambda v: f"({_times(f'xor(h, {_round(number(0), v)})', p1)} + {number(p4)}) % {MOD}"
    eights = _fold("h", f"list_transform(range(0, n % 32 // 8), lambda k: {_word('n // 32 * 32 + k * 8', 8)})", _let(f"xor(a, {_round(number(0), 'w')})", f"({_times(_turned('t', 27), p1)} + {number(p4)}) % {MOD}"))
    four = _let(f"xor(h, {_times(_word('n // 8 * 8', 4), p1)})", f"({_times(_turned('t', 23), p2)} + {number(p3)}) % {MOD}")
    ones = _fold("h", f"list_transform(range(n // 4 * 4, n), lambda k: {_word('k', 1)})", _let(f"xor(a, {_times('w', p5)})", _times(_turned("t", 11), p1)))
    return f"""hx as (select s, hex(encode(s)) as x, strlen(s) as n from {source}),
 hv as (select s, x, n, {", ".join(f"{v} as v{i}" for i, v in enumerate(lanes))} from hx where n >= 32),
 h0 as (select *, ({_turned("v0", 1)} + {_turned("v1", 7)} + {_turned("v2", 12)} + {_turned("v3", 18)}) % {MOD} as h from hv),
 h1 as (select * replace ({merged("v0")} as h) from h0), h2 as (select * replace ({merged("v1")} as h) from h1),
 h3 as (select * replace ({merged("v2")} as h) from h2), h4 as (select * replace ({merged("v3")} as h) from h3),
 h5 as (select s, x, n, (h + n::uhugeint) % {MOD} as h from h4 union all select s, x, n, ({number(seed + p5)} + n::uhugeint) % {MOD} from hx where n < 32),
 h6 as (select * replace ({eights} as h) from h5), h7 as (select * replace (case when n % 8 >= 4 then {four} else h end as h) from h6), h8 as (select s, {ones} as h from h7),
 h9 as (select s, {_times(f"xor(h, h // {number(1 << 33)})", p2)} as h from h8), ha as (select s, {_times(f"xor(h, h // {number(1 << 29)})", p3)} as h from h9),
 hashed as (select s, xor(h, h // {number(1 << 32)})::ubigint as h from ha)"""

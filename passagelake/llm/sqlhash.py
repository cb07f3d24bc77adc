"""XXH64 in DuckDB SQL, for the SQL versions of queries that hash texts."""

from __future__ import annotations

#: The primes of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_ALL = (1 << 64) - 1


def _mul(a: str, b: str | int) -> str:
    return f"CAST(CAST({a} AS UHUGEINT) * CAST({b} AS UHUGEINT) & {_ALL}::UHUGEINT AS UBIGINT)"


def _add(*each: str | int) -> str:
    return f"CAST(({' + '.join(f'CAST({x} AS UHUGEINT)' for x in each)}) & {_ALL}::UHUGEINT AS UBIGINT)"


def _rotated(x: str, by: int) -> str:
    return f"CAST(((CAST({x} AS UHUGEINT) << {by}) & {_ALL}::UHUGEINT) | (CAST({x} AS UHUGEINT) >> {64 - by}) AS UBIGINT)"


def _round(acc: str, lane: str) -> str:
    return _mul(_rotated(_add(acc, _mul(lane, P2)), 31), P1)


def _number(at: str, width: int) -> str:
    """The little-endian number of `width` bytes of x, a text in hexadecimal digits, at byte `at`."""
    digits = " || ".join(f"substr(x, CAST(2 * ({at}) + {2 * i + 1} AS BIGINT), 2)" for i in reversed(range(width)))
    return f"CAST('0x' || {digits} AS UBIGINT)"


def _folded(start: str, many: str, at: str, width: int, step: str) -> str:
    """The list of numbers at `at` (of i, from 0 to many - 1), folded from start by `step` (of h and v)."""
    return f"list_reduce(list_prepend({start}, list_transform(range({many}), lambda i: {_number(at, width)})), lambda h, v: {step})"


def hashed(name: str, rows: str, text: str, seed: str) -> str:
    """CTEs; the last, called name, has the columns of the CTE `rows` and `h`, the XXH64 of column text with the seed, a UBIGINT."""
    accs = [_add("seed_", P1, P2), _add("seed_", P2), "seed_", _add("seed_", _ALL + 1 - P1)]
    folded = ", ".join(f"{_folded(a, 'n // 32', f'32 * i + {8 * j}', 8, _round('h', 'v'))} AS a{j}" for j, a in enumerate(accs))
    merged = _add(*[_rotated(f"a{j}", r) for j, r in enumerate((1, 7, 12, 18))])
    whole = f"list_reduce([{merged}, {', '.join(_round('0::UBIGINT', f'a{j}') for j in range(4))}], lambda h, v: {_add(_mul('xor(h, v)', P1), P4)})"
    eight = _folded("h", "(n % 32) // 8", "n - n % 32 + 8 * i", 8, _add(_mul(_rotated(f"xor(h, {_round('0::UBIGINT', 'v')})", 27), P1), P4))
    four = _folded("h", "(n % 8) // 4", "n - n % 8", 4, _add(_mul(_rotated(f"xor(h, {_mul('v', P1)})", 23), P2), P3))
    one = _folded("h", "n % 4", "n - n % 4 + i", 1, _mul(_rotated(f"xor(h, {_mul('v', P5)})", 11), P1))
    return f"""
{name}_0 AS (SELECT *, hex(encode({text})) AS x, octet_length(encode({text})) AS n, CAST({seed} AS UBIGINT) AS seed_ FROM {rows}),
{name}_1 AS (SELECT *, {folded} FROM {name}_0),
{name}_2 AS (SELECT * EXCLUDE (a0, a1, a2, a3), {_add(f"CASE WHEN n >= 32 THEN {whole} ELSE {_add('seed_', P5)} END", "n")} AS h FROM {name}_1),
{name}_3 AS (SELECT * REPLACE ({eight} AS h) FROM {name}_2),
{name}_4 AS (SELECT * REPLACE ({four} AS h) FROM {name}_3),
{name}_5 AS (SELECT * REPLACE ({one} AS h) FROM {name}_4),
{name}_6 AS (SELECT * REPLACE ({_mul('xor(h, h >> 33)', P2)} AS h) FROM {name}_5),
{name}_7 AS (SELECT * REPLACE ({_mul('xor(h, h >> 29)', P3)} AS h) FROM {name}_6),
{name} AS (SELECT * EXCLUDE (x, n, seed_) REPLACE (xor(h, h >> 32) AS h) FROM {name}_7)"""

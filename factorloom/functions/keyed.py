"""Randomness as expressions: the same numbers for the same keys, whatever the partitions.

All functions are built on MD5 and whole numbers below 2^62, so any SQL engine can repeat them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A prime below 2^31, so that products of two residues fit a long.
PRIME = 2147483647
ROUNDS = 4


def digest(*keys: Column | int | str) -> Column:
    """Hex digits that the keys, joined by colons, decide."""
    return F.md5(F.concat_ws(":", *[(k if isinstance(k, Column) else F.lit(k)).cast("string") for k in keys]))


def number(hexadecimal: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(hexadecimal, start, digits), 16, 10).cast("long")


def uniform(*keys: Column | int | str) -> Column:
    """A number in [0, 1) of 52 bits."""
    return number(digest(*keys), 1, 13) / float(1 << 52)


def _mixed(v: Column, key: Column) -> Column:
    """A number below PRIME from a smaller one and a hexadecimal key: a square, scaled and shifted."""
    y = (v + number(key, 1, 7)) % PRIME
    return ((y * y) % PRIME * (number(key, 8, 7) + 1) + number(key, 15, 7)) % PRIME


def distinct_places(n: Column, total: int, *keys: Column | int) -> Column:
    """The first ``n`` (at most ``total``) places of a keyed permutation of 0 to total - 1, as an array.

    Numbers are pairs of a coarse and a fine part, each round shifting one part by a mixture of
    the other, which is one-to-one on the rectangle of pairs.  The rectangle has fewer than
    two sides more than ``total``; its surplus is left out, and as many more are tried.
    """
    if total < 1:
        return F.array().cast("array<bigint>")
    high = math.isqrt(total - 1) + 1
    low = -(-total // high)
    parts = F.array(*[digest(*keys, j) for j in range(ROUNDS)])

    def turn(j: int, key: Column):
        if j % 2:
            return lambda p: F.struct(p["h"].alias("h"), ((p["l"] + _mixed(p["h"], key[j])) % low).alias("l"))
        return lambda p: F.struct(((p["h"] + _mixed(p["l"], key[j])) % high).alias("h"), p["l"].alias("l"))

    def place(x: Column, key: Column) -> Column:
        pair = F.struct(F.floor(x / low).alias("h"), (x % low).alias("l"))
        for j in range(ROUNDS):
            pair = F.transform(F.array(pair), turn(j, key))[0]
        return F.transform(F.array(pair), lambda p: p["h"] * low + p["l"])[0]

    tried = F.sequence(F.lit(0).cast("long"), (n + (high * low - total) - 1).cast("long"))
    all_of = F.transform(F.array(parts), lambda key: F.transform(tried, lambda x: place(x, key)))[0]
    few = F.slice(F.filter(all_of, lambda p: p < total), F.lit(1), n.cast("int"))
    return F.when(n > 0, few).otherwise(F.array().cast("array<bigint>"))


def distinct_places_sql(sizes: str, total: str, permutations: int, seed: int) -> str:
    """The same as SQL text: rows (n, perm, place) for the column n of the table ``sizes`` and each permutation."""
    rounds = []
    for j in range(ROUNDS):
        key = f"md5('{seed}:' || CAST(n AS VARCHAR) || ':' || CAST(perm AS VARCHAR) || ':{j}')"
        part = lambda a, key=key: f"CAST('0x' || substr({key}, {a}, 7) AS BIGINT)"
        v = "l" if j % 2 == 0 else "h"
        y = f"(({v} + {part(1)}) % {PRIME})"
        mixed = f"((({y} * {y}) % {PRIME} * ({part(8)} + 1) + {part(15)}) % {PRIME})"
        now = f"(h + {mixed}) % high AS h, l" if j % 2 == 0 else f"h, (l + {mixed}) % low AS l"
        rounds.append(f"fr{j + 1} AS (SELECT n, perm, x, high, low, total, {now} FROM fr{j})")
    return f"""fg AS (SELECT total, high, CAST(ceil(total / high) AS BIGINT) AS low FROM (SELECT total, CAST(ceil(sqrt(total)) AS BIGINT) AS high FROM (SELECT CAST(({total}) AS BIGINT) AS total))),
fx AS (SELECT s.n, p.perm, fg.*, unnest(generate_series(0, s.n + high * low - total - 1)) AS x FROM (SELECT DISTINCT n FROM {sizes}) s CROSS JOIN (SELECT unnest(generate_series(1, {permutations})) AS perm) p CROSS JOIN fg),
fr0 AS (SELECT n, perm, x, high, low, total, x // low AS h, x % low AS l FROM fx),
{", ".join(rounds)},
fv AS (SELECT n, perm, h * low + l AS place, row_number() OVER (PARTITION BY n, perm ORDER BY x) AS k FROM fr{ROUNDS} WHERE h * low + l < total),
drawn AS (SELECT n, perm, place FROM fv WHERE k <= n)"""

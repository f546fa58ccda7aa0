"""A seeded 32-bit string hash as a column expression: FNV-1a over UTF-16 units below 65,536, then a finaliser.

All arithmetic stays inside BIGINT: a 32-bit product is taken in two halves, so ANSI mode never overflows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The FNV-1a basis and prime, the finaliser's multipliers.
BASIS, PRIME = 2166136261, 16777619
MIX_1, MIX_2 = 2246822507, 3266489909
MASK = 4294967295


def _times(value: Column, factor: int) -> Column:
    high, low = F.shiftrightunsigned(value, 16), value.bitwiseAND(65535)
    return (F.lit(65536) * (high * F.lit(factor)).bitwiseAND(65535) + low * F.lit(factor)).bitwiseAND(MASK)


def _let(value: Column, body) -> Column:
    """body(value), the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def letters_of(text: Column) -> Column:
    """Units of a text as numbers: what hashes of several seeds share."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def hashes(text: Column, seeds: Column, use) -> Column:
    """use(seed, hash) for each of an array of seeds; the text is taken apart once."""
    return _let(letters_of(text), lambda letters: F.transform(seeds, lambda seed: use(seed, hash_letters(letters, seed))))


def hash32(text: Column, seed: int | Column = 0) -> Column:
    """Unsigned 32-bit hash as BIGINT; null for null. Characters beyond the basic plane count by their first unit."""
    return hash_letters(letters_of(text), seed)


def hash_letters(letters: Column, seed: int | Column = 0) -> Column:
    start = F.lit(BASIS).cast("long").bitwiseXOR((seed if isinstance(seed, Column) else F.lit(seed)).cast("long"))
    folded = F.aggregate(letters, start, lambda h, c: _times(h.bitwiseXOR(c), PRIME))

    def finish(h: Column) -> Column:
        def last(a: Column) -> Column:
            return _let(_times(a.bitwiseXOR(F.shiftrightunsigned(a, 13)), MIX_2), lambda b: b.bitwiseXOR(F.shiftrightunsigned(b, 16)))

        return _let(_times(h.bitwiseXOR(F.shiftrightunsigned(h, 16)), MIX_1), last)

    return _let(folded, finish)


def hash32_sql(text: str, seed: str) -> str:
    """The same hash as DuckDB SQL."""
    folded = f"list_reduce(list_prepend(xor({BASIS}::BIGINT, ({seed})::BIGINT)::HUGEINT, [ascii(c)::HUGEINT FOR c IN string_split({text}, '') IF c <> '']), lambda h, c: (xor(h, c) * {PRIME}) & {MASK})"
    a = f"(xor({folded}, {folded} >> 16) * {MIX_1}) & {MASK}"
    return a

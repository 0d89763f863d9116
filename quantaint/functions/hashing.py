"""Cheap families of uniform hashes for sampling.

A text is digested once into four words (two halves, low and high part); draw number k then costs a few integer
operations: (a k + b) mod P for two word pairs, each stirred by a shift and a
product. Within one draw the values of different texts are independent and
uniform. The stirring removes the linear relations between draws: without it two
texts with nearly proportional words keep their order over many draws.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A Mersenne prime whose products fit in a bigint, the stirring
# shift and multiplier, and the number of bits of a hash (two residues).
P = 2**31 - 1
SHIFT = 16
MULTIPLIER = 73244475
BITS = 62


def digest_words(text: str) -> Column:
    """Four numbers below P from the MD5 of a text, given as an SQL expression.

    They are declared non-null: the optimizer would otherwise repeat the digest
    in a null test before every filter or join on a hash.
    """
    words = []
    for start in (1, 17):
        half = f"cast(conv(substring(md5({text}), {start}, 15), 16, 10) as bigint)"
        words += [f"{half} % {P}", f"shiftright({half}, 31)"]
    named = [f"'w{i}', coalesce({word}, 0)" for i, word in enumerate(words, 1)]
    return F.expr(f"named_struct({', '.join(named)})")


def with_draws(df: DataFrame, words: dict[str, str], k: str) -> DataFrame:
    """Add hash columns in [0, 2^62): ``words`` maps new names to word structs.

    The linear parts get a projection of their own. The stirring refers to them
    twice, so the projections stay apart and the generated methods stay small
    enough for the JVM to compile.
    """
    linear = {}
    stirred = {}
    for name, w in words.items():
        linear[f"{name}_high"] = F.expr(f"({w}.w1 * {k} + {w}.w2) % {P}")
        linear[f"{name}_low"] = F.expr(f"({w}.w3 * {k} + {w}.w4) % {P}")
        high, low = (
            f"(({x} ^ shiftright({x}, {SHIFT})) * {MULTIPLIER} % {P})"
            for x in (f"{name}_high", f"{name}_low")
        )
        stirred[name] = F.expr(f"{high} * {2**31}L + {low}")
    return df.withColumns(linear).withColumns(stirred).drop(*linear)

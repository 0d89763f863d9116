"""Text form of tuple identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantaint.schema import KEYS


def pk_text(relation: str, columns: tuple[str, ...] | None = None) -> Column:
    """Key columns joined by commas; a tuple without a full key is an error.

    ``concat_ws`` skips nulls, which would turn (7, null) into "7", so the null
    test comes first.
    """
    columns = columns or KEYS[relation]
    parts = [F.col(c).cast("string") for c in columns]
    complete = parts[0].isNotNull()
    for part in parts[1:]:
        complete = complete & part.isNotNull()
    text = parts[0] if len(parts) == 1 else F.concat_ws(",", *parts)
    return F.when(complete, text).otherwise(
        F.raise_error(F.lit(f"{relation}: tuple without a key"))
    )


def tuple_struct(relation: str) -> Column:
    return F.struct(F.lit(relation).alias("relation"), pk_text(relation).alias("pk"))


def tuple_id(relation: Column, pk: Column) -> Column:
    return F.concat(relation, F.lit("#"), pk)


def normalise_pk_text(raw: Column) -> Column:
    """One JSON key ("7", "[7]", "[7, 3]") as comma-separated integers.

    Anything that is not a non-empty list of integers fails the cast or the
    explicit check.
    """
    # Brackets, quotes and blanks, by character: no pattern is matched per key.
    bare = F.translate(raw, '[]" \t\n\x0b\f\r', "")
    numbers = F.transform(F.split(bare, ","), lambda x: x.cast("bigint").cast("string"))
    return F.when(F.length(bare) == 0, F.raise_error(F.lit("empty key"))).otherwise(
        F.array_join(numbers, ",")
    )

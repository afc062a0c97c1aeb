"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the characters that count as white space when text is stripped.
BLANK = (
    r"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0"
    r"\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def has_text(text: Column) -> Column:
    """Whether anything is left after stripping white space."""
    return text.rlike(f"[^{BLANK}]")


def clamp(value: Column, low: Column, high: Column) -> Column:
    """``value`` held between ``low`` and ``high``; ``low`` wins if they cross."""
    return F.greatest(low, F.least(high, value))


def hash_key(identifier: Column, seed: int) -> Column:
    """A seeded pseudo-random sort key, the same in every engine with MD5."""
    text = identifier.cast("string")
    return F.concat(F.md5(F.concat(F.lit(f"{seed}:"), text).cast("binary")), F.lit(":"), text)


def softmax(logits: Column) -> Column:
    """Softmax of an array, shifted by its maximum."""
    shifted = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return let(
        shifted,
        lambda powers: let(
            F.aggregate(powers, F.lit(0.0), lambda total, x: total + x),
            lambda total: F.transform(powers, lambda x: x / total),
        ),
    )


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds of a time column on its own clock.

    A timestamp without zone is taken apart instead of cast: a cast would read it in
    the session's zone, where a change of daylight saving time shifts differences.
    """
    ts = F.col(name)
    if not isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return F.unix_micros(ts)
    day = F.unix_date(ts.cast("date")).cast("long")
    seconds = day * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")

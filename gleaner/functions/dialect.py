"""SQL expression text for two engines: Spark, which runs it, and DuckDB, which checks it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Spark:
    name = "spark"

    @staticmethod
    def lit(s: str) -> str:
        """A raw literal; quotes inside become escapes, as all that have some are patterns."""
        return "r'" + s.replace("'", r"\x27") + "'"

    @classmethod
    def has(cls, s: str, pattern: str) -> str:
        return f"({s} rlike {cls.lit(pattern)})"

    @classmethod
    def get(cls, s: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({s}, {cls.lit(pattern)}, {group})"

    @classmethod
    def every(cls, s: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({s}, {cls.lit(pattern)}, {group})"

    @classmethod
    def sub(cls, s: str, pattern: str, to: str) -> str:
        return f"regexp_replace({s}, {cls.lit(pattern)}, {cls.lit(to)})"

    @classmethod
    def count(cls, s: str, pattern: str) -> str:
        return f"cast(regexp_count({s}, {cls.lit(pattern)}) as bigint)"

    @staticmethod
    def bytes(s: str) -> str:
        return f"cast(octet_length({s}) as bigint)"

    @staticmethod
    def size(s: str) -> str:
        return f"cast(size({s}) as bigint)"

    @staticmethod
    def div(a: str, b: str) -> str:
        return f"(({a}) div ({b}))"

    @staticmethod
    def total(arr: str) -> str:
        return f"aggregate({arr}, cast(0 as bigint), (a, x) -> a + octet_length(x))"


class Duck(Spark):
    name = "duck"

    @staticmethod
    def lit(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    @classmethod
    def has(cls, s: str, pattern: str) -> str:
        return f"regexp_matches({s}, {cls.lit(pattern)})"

    @classmethod
    def sub(cls, s: str, pattern: str, to: str) -> str:
        return f"regexp_replace({s}, {cls.lit(pattern)}, {cls.lit(to.replace('$', chr(92)))}, 'g')"

    @classmethod
    def count(cls, s: str, pattern: str) -> str:
        return f"len(regexp_extract_all({s}, {cls.lit(pattern)}))"

    @staticmethod
    def bytes(s: str) -> str:
        return f"strlen({s})"

    @staticmethod
    def size(s: str) -> str:
        return f"len({s})"

    @staticmethod
    def div(a: str, b: str) -> str:
        return f"(({a}) // ({b}))"

    @staticmethod
    def total(arr: str) -> str:
        return f"coalesce(list_sum(list_transform({arr}, lambda x: strlen(x)))::BIGINT, 0)"


def column(make, *args: str, **options) -> Column:
    """The Spark column of an expression maker."""
    return F.expr(make(Spark, *args, **options))

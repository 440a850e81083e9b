"""What several operators need: shared-folder tables and safe column handling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.sources.store import cut, new_path, remove, work_dir

__all__ = ["WHITE", "WHITE_RUN", "beside", "cut", "free_name", "key128", "new_path", "remove", "work_dir"]
#: White space that separates words in all operators: space, \t, \n, \v, \f, \r.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = "[\\x20\\x09-\\x0D]+"


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have in any spelling."""
    taken = {c.lower() for c in df.columns}
    name = f"_{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def beside(rows: DataFrame, few: DataFrame, by: str, spread: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """``rows`` with the columns of ``few`` (one row per ``by``); the rows of a hot ``by`` are
    spread over ``salts`` tasks by a hash of the column ``spread``."""
    salt = free_name(rows, "salt")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias(salt)
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(F.lit("salt"), spread), F.lit(salts)).cast("int"))
    return rows.join(few.select("*", every), [by, salt], how).drop(salt)


def key128(column) -> list:
    """Two independent 64-bit hashes of a column: a 128-bit identity of its value."""
    return [F.xxhash64(column), F.xxhash64(F.lit("second"), column)]

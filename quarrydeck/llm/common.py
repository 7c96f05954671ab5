"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarrydeck.session import checkpoint_dir, cut, ship_code

__all__ = ["checkpoint_dir", "cut", "free_name", "let", "ship_code", "table", "tokenizer_path"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table."""
    return ship_code(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it, such that df has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokenizer_path(name: str) -> str:
    """Where this machine keeps a public vocabulary file. Called on the worker that opens the file."""
    import public_tokenizers

    return public_tokenizers.path(name)

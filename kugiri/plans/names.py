"""Column names of tables that may hold anything."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def columns(df: DataFrame, without: tuple[str, ...] = ()) -> list[Column]:
    """df's columns, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in without]


def free(df: DataFrame, name: str, without: tuple[str, ...] = ()) -> str:
    """name, with as many underscores behind it as make it differ from df's columns (letter case doesn't count)."""
    taken = {c.lower() for c in df.columns if c not in without}
    while name.lower() in taken:
        name += "_"
    return name

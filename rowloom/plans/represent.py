"""From an entity table to feature matrices on disk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.operators.features import featurise
from rowloom.operators.profile import matrix_shape
from rowloom.sources.matrix import read_matrix, write_matrix


def represent(
    df: DataFrame, id_col: str, jobs: dict[str, tuple[str | Callable[..., DataFrame], str, dict]], folder: str, widths: dict[str, int]
) -> DataFrame:
    """Write one matrix per job and report its shape as read back: (matrix, n_rows, width).

    ``jobs`` maps the matrix name to (method or function, column, options).
    """
    report = None
    for name, (method, column, options) in jobs.items():
        write_matrix(featurise(df, id_col, column, method, **options), id_col, "features", f"{folder}/{name}.tsv", widths[name])
        read = read_matrix(df.sparkSession, f"{folder}/{name}.tsv", id_col)
        shape = matrix_shape(read, "features").select(F.lit(name).alias("matrix"), "n_rows", "width")
        report = shape if report is None else report.unionByName(shape)
    return report

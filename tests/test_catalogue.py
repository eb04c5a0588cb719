import pytest
from pyspark.errors import ArithmeticException

from relengine.catalogue import QUERIES


def vectors(spark, path, rows):
    spark.createDataFrame(rows, "embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return sorted(map(tuple, QUERIES["difference_arrays"](spark, str(path)).collect()), key=str)


def test_totals_of_float_vectors_are_those_of_sql(spark, tmp_path):
    """Expected totals are DuckDB's on the query's SQL: 1000 * 0.131 is 131 as a float and 130.999997 as a double."""
    rows = [([0.131], 1), ([0.131], 1), ([-0.1], 2), ([-1e-9], None), ([0.25, 0.5], 1), ([0.25, 0.5], 0), ([0.0], 0), ([-0.0], 1)]
    assert vectors(spark, tmp_path / "a", rows) == [(1, -1), (1, -100), (1, 131)]
    rows = [([None, 0.5], 1), ([None, None], 1), ([], 1), (None, 1), ([1e30, -1e30, 0.25], 1), ([3e15, 1.0], 1)]
    assert vectors(spark, tmp_path / "b", rows) == sorted([(2, 500), (2, None), (0, None), (None, None), (3, 250), (2, 3000000159078679552)], key=str)


@pytest.mark.parametrize("x", [float("nan"), float("inf"), 1e38, 1e20])
def test_totals_that_are_no_long_raise(spark, tmp_path, x):
    with pytest.raises(ArithmeticException):
        vectors(spark, tmp_path, [([x, 0.5], 1)])

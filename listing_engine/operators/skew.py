"""Cutting heavy join keys into rectangles by the counted sizes of both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Row and column of the rectangle that a pair of rows meets in; join on these, too.
SALT = ["salt_big__", "salt_small__"]
#: No key is cut into more rows or columns than this to save pairs, so the rows that are shuffled grow with the input only.
MOST_REPEATS = 32


def split_hot_keys(
    big: DataFrame, small: DataFrame, keys: list[str], big_id: Column, small_id: Column, pairs_per_task: int, rows_per_task: int
) -> tuple[DataFrame, DataFrame]:
    """Salt the keys that would form more than `pairs_per_task` pairs or hold more than `rows_per_task` rows of a side.

    A key with n rows of `big` and m of `small` is n x m pairs. Both sides are
    counted (partial sums before the shuffle) and the rectangle is cut along
    both, into cells of about `pairs_per_task` pairs that are as square as the
    sides allow, since a row is repeated once per cell in its row or column. With
    both sides long a row is repeated MOST_REPEATS times at most; beyond that the
    cells grow, which a join streams through one side after the other. A
    row takes its place along its own side by hash of its id, so joining on keys
    + SALT yields exactly the same pairs as joining on keys, each once.
    """
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    n, m, side = F.col("n__").cast("double"), F.col("m__").cast("double"), F.lit(float(pairs_per_task)).cast("double") ** 0.5
    pieces = F.ceil(n * m / F.lit(float(pairs_per_task)))
    both_long = (n > side) & (m > side)
    cuts = lambda own, other: F.greatest(
        F.when(both_long, F.least(F.ceil(own / side), F.lit(MOST_REPEATS))).when(own >= other, pieces).otherwise(F.lit(1)), F.ceil(own / F.lit(float(rows_per_task))), F.lit(1)
    ).cast("int")
    heavy = (
        count(big, "n__")
        .join(count(small, "m__"), keys)
        .filter((n * m > pairs_per_task) | (n > rows_per_task) | (m > rows_per_task))
        .select(*keys, cuts(n, m).alias("rows__"), cuts(m, n).alias("columns__"))
    )
    rows, columns = F.coalesce("rows__", F.lit(1)), F.coalesce("columns__", F.lit(1))
    every = lambda cuts: F.explode(F.sequence(F.lit(0), cuts - 1))
    own = lambda row_id, cuts: F.pmod(F.xxhash64(row_id), cuts).cast("int")
    left = big.join(heavy, keys, "left").withColumns({SALT[0]: own(big_id, rows)}).withColumn(SALT[1], every(columns))
    right = small.join(heavy, keys, "left").withColumns({SALT[1]: own(small_id, columns)}).withColumn(SALT[0], every(rows))
    return left.drop("rows__", "columns__"), right.drop("rows__", "columns__")


def all_pairs(big: DataFrame, small: DataFrame, big_id: Column, small_id: Column, pairs_per_task: int, rows_per_task: int) -> DataFrame:
    """Every row of `big` with every row of `small`, in as many even rectangles as their counts ask for."""
    one = lambda df: df.withColumn("all__", F.lit(0))
    left, right = split_hot_keys(one(big), one(small), ["all__"], big_id, small_id, pairs_per_task, rows_per_task)
    return left.join(right, ["all__", *SALT]).drop("all__", *SALT)

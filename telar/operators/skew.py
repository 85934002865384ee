"""A join of many rows to one row per key that stands a key with a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telar.session import width


def skew_safe_join(big: DataFrame, small: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of ``big`` to ``small``, which has one row per key and in ``count`` the key's rows in ``big``.

    Keys with more rows than an even share of a partition are hot. There are fewer of them
    than partitions (each has over 1/n of all rows), so their rows of ``small`` are broadcast within a proven
    bound and their rows of ``big`` stay where they are. All other keys are joined by a
    shuffle. ``small`` is read several times: have it checkpointed. Null keys match nothing, as in any equi-join.
    """
    n = width(big.sparkSession)
    share = (small.agg(F.sum(count)).first()[0] or 0) / n
    hot, cold = (small.filter(x).drop(count) for x in (F.col(count) > share, F.col(count) <= share))
    return big.join(F.broadcast(hot), keys).unionByName(big.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))

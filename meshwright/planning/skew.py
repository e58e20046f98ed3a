"""Looking up facts by a key that may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key with more rows than this is hot. There are at most (number of rows / HOT) such keys, so
#: the facts of hot keys are few whatever the data: 10,000 for ten billion rows.
HOT = 1_000_000


def look_up(rows: DataFrame, facts: DataFrame, key: str | list[str], spread: str | list[str], hot: int = HOT, most: int | None = None) -> DataFrame:
    """``rows`` left joined with ``facts`` (one row per ``key``, all columns non-null).

    Facts of hot keys are broadcast; their number is bounded, see ``HOT``. All other rows meet
    their facts in a shuffle, in which the rows of hot keys are spread by the columns ``spread``
    (as many as ``key`` has, of the same types), so no task gets a hot key's rows. ``most`` is a
    known bound of the number of rows: where it is at most ``hot`` no key can be hot, and one
    join is all there is.
    """
    keys, own = ([c] if isinstance(c, str) else list(c) for c in (key, spread))
    values = [c for c in facts.columns if c not in keys]
    if most is not None and most <= hot:
        return rows.join(facts, keys, "left").select(*rows.columns, *values)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot).select(*keys)
    of_hot = facts.join(F.broadcast(counts), keys, "left_semi").withColumnsRenamed({c: f"__hot_{c}" for c in values})
    near = rows.join(F.broadcast(of_hot), keys, "left")
    is_hot = F.col(f"__hot_{values[0]}").isNotNull()
    at = {f"__at{i}": F.when(is_hot, F.col(s)).otherwise(F.col(k)) for i, (k, s) in enumerate(zip(keys, own))}
    near = near.withColumns({**at, "__is": is_hot})
    cold = facts.select(F.lit(False).alias("__is"), *[F.col(k).alias(f"__at{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"__cold_{c}") for c in values])
    joined = near.join(cold, ["__is", *at], "left")
    return joined.select(*rows.columns, *[F.coalesce(f"__hot_{c}", f"__cold_{c}").alias(c) for c in values])

"""A sample that stays when data arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerwake.operators.skew import order_statistics
from ledgerwake.session import materialize, release

#: Cuts of up to this many batches are broadcast; those of more are joined.
MAX_BATCHES = 100_000


def frozen_sample(df: DataFrame, key: str, batch: str, rate: float, salt: str = "frozen-1", bins: int = 256) -> DataFrame:
    """(key, batch) of the sampled keys: in each arrival batch the ceil(rate x size) of least salted hash.

    A key belongs to the lowest batch that it occurs in; size is the number of keys
    of that batch. As later batches never change earlier ones, a sampled key
    stays sampled, and neither reruns nor partitionings change the result. Keys of equal
    hash are taken in the order of the key. The hash is the first 15 hex
    digits of md5 of salt, ``:`` and key, and so the same on any system.

    Null keys and rows with a null batch (not arrived yet) are left out.
    Repeated rows change nothing; an empty table gives an empty sample.

    The k-th least hash of each batch is found by counting (order_statistics,
    on the hash's two halves), so no task sorts a batch.
    """
    first = df.where(F.col(key).isNotNull() & F.col(batch).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min(batch).alias("__batch"))
    digest = F.md5(F.concat(F.lit(f"{salt}:"), F.col("__key").cast("string")))
    half = lambda a, n: F.conv(F.substring(digest, a, n), 16, 10).cast("long")
    keys = materialize(first.select("__key", "__batch", half(1, 12).alias("__h"), half(13, 3).alias("__low")), "sample-keys")
    sizes = keys.groupBy("__batch").agg(F.count("*").alias("n"), F.min("__h").alias("lo"), F.max("__h").alias("hi"))
    take = F.ceil(F.lit(float(rate)) * F.col("n")).cast("long")
    wanted = sizes.where(take > 0).select("__batch", (F.least(take, F.col("n")) - 1).alias("rank"), "lo", "hi")
    # 48 bits fit a double exactly
    cuts = order_statistics(keys.select("__batch", "__h"), "__batch", "__h", wanted, bins).select("__batch", F.col("result").cast("long").alias("__cut"), (F.col("rank") + 1).alias("__take"))
    few = cuts.limit(MAX_BATCHES + 1).count() <= MAX_BATCHES
    marked = keys.join(F.broadcast(cuts) if few else cuts, "__batch")
    below = marked.where("__h < __cut")
    full = below.groupBy("__batch").agg(F.count("*").alias("__n"))
    # keys that share the first 12 digits with the last one taken: one, but for coincidence
    w = Window.partitionBy("__batch").orderBy("__low", "__key")
    edge = marked.where("__h = __cut").withColumn("__no", F.row_number().over(w)).join(full, "__batch", "left").where("__no <= __take - coalesce(__n, 0)")
    out = materialize(below.select("__key", "__batch").unionByName(edge.select("__key", "__batch")), "sample")
    release(keys)
    return out.select(F.col("__key").alias(key), F.col("__batch").alias(batch))


def sampled_rows(df: DataFrame, key: str, batch: str, rate: float, salt: str = "frozen-1") -> DataFrame:
    """All rows of ``df`` whose key is in the frozen_sample, those of later batches included."""
    return df.join(frozen_sample(df, key, batch, rate, salt).select(key), key, "left_semi").select(*df.columns)

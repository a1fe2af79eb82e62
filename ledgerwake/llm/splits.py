"""Train, validation and test splits that keep linked records together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwake.operators.skew import running_labels
from ledgerwake.session import materialize, release

#: Groups of a 20,000th of the rows or more, of which there are 20,000 at most, are placed by the driver.
LARGE_SHARE = 20_000
#: Steps of this fraction of the circle spread any number of points evenly.
GOLDEN = 0.6180339887498949


def _to_root(mapping: DataFrame) -> DataFrame:
    """Follow (node, to), to <= node, until every node points at its root; both nodes and roots are in ``mapping``."""
    while True:
        ends = mapping.where("node != to").select(F.col("node").alias("at"), F.col("to").alias("further"))
        jumped = mapping.join(ends, mapping["to"] == ends["at"], "left").select("node", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved"))
        jumped = materialize(jumped, "roots")
        release(mapping)
        if jumped.where("moved").isEmpty():
            return jumped.drop("moved")
        path, mapping = jumped._ledgerwake_path, jumped.drop("moved")
        mapping._ledgerwake_path = path


def linked(records: DataFrame, node: str, entity: str) -> DataFrame:
    """(node, group): nodes that share an entity, directly or through others, get one group.

    ``records`` links nodes to entities; group is the least node. Rows with a
    null node are left out; a null entity links nothing, yet its node comes
    out. Repeated rows change nothing; an empty table gives no rows.

    Each round, every entity takes the least node it touches and every node the
    least of its entities' (both are aggregates with map-side combine, so an
    entity of any number of records is no burden), the pointers are followed to
    their roots, and the links are rewritten from nodes to roots. Entities left
    with one root are done and dropped. Roots at least halve in every round, as
    each node that still shares an entity points at another or is pointed at,
    so long chains take a logarithmic number of rounds.
    """
    pairs = materialize(records.where(F.col(node).isNotNull()).select(F.col(node).alias("node"), F.col(entity).alias("entity")).distinct(), "links")
    links = pairs.where("entity is not null")
    found = pairs.select("node", F.col("node").alias("group")).distinct()
    held = [pairs]
    mine: DataFrame | None = None
    old: DataFrame | None = None
    while True:
        least = links.groupBy("entity").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("entity", "least")
        open_links = materialize(links.join(least, "entity").select("node", "entity", "least"), "open-links")
        if old is not None:
            release(old)
        if open_links.isEmpty():
            held.append(open_links)
            break
        roots = _to_root(materialize(open_links.groupBy("node").agg(F.min("least").alias("to")), "hooks"))
        links = materialize(open_links.join(roots, "node").select(F.col("to").alias("node"), "entity").distinct(), "links")
        release(open_links)
        old = links
        # the groups found so far are rewritten by the new roots
        stepped = found.join(roots.select(F.col("node").alias("group"), "to"), "group", "left").select("node", F.coalesce("to", "group").alias("group"))
        stepped = materialize(stepped, "groups")
        if mine is not None:
            release(mine)
        release(roots)
        mine = found = stepped
    if mine is None:
        found = materialize(found, "groups")
    release(*held)
    return found.withColumnRenamed("node", node)


def place(units: Sequence[tuple[object, Sequence[int]]], shares: Sequence[float], total: Sequence[int]) -> tuple[dict[object, int], list[float]]:
    """A split for each (unit, rows of each label), and the rows that every split still lacks.

    The largest first, each to where it least raises the deviation: the sum over
    splits and labels of (rows - wanted)^2 / wanted, where wanted are the ``shares``
    of the ``total`` rows of each label.
    """
    labels = range(len(total))
    wanted = [[max(s * t, 1e-9) for t in total] for s in shares]
    have = [[0.0] * len(total) for _ in shares]
    out = {}
    for unit, rows in sorted(units, key=lambda u: (-sum(u[1]), str(u[0]))):
        costs = [sum((2 * (have[s][i] - wanted[s][i]) * rows[i] + rows[i] ** 2) / wanted[s][i] for i in labels if rows[i]) for s in range(len(shares))]
        best = out[unit] = min(range(len(shares)), key=lambda s: (costs[s], s))
        for i in labels:
            have[best][i] += rows[i]
    return out, [max(0.0, sum(w) - sum(h)) for w, h in zip(wanted, have, strict=True)]


def grouped_splits(rows: DataFrame, group: str, labels: Sequence[Column], splits: Sequence[tuple[str, float]], salt: str = "split-1", target_rows: int = 100_000, large_share: int = LARGE_SHARE) -> DataFrame:
    """(group, split): whole groups divided in the given proportions, alike in their labels.

    ``labels`` are conditions; their combinations are the classes whose
    distribution the splits share. Every group is placed on its own. Groups of a
    ``large_share``-th of all rows or more are placed by the driver, the largest first,
    where the deviation grows least. Smaller groups of equal class counts are
    interchangeable: they are numbered by salted hash and dealt to the
    splits by what these still lack, in an even pattern that begins at another place for
    each vector of counts. So no split's part of a vector is off by more than about a
    group, and nothing but the large groups reaches the driver. The result depends
    on the rows alone, not on their order. Rows with a null group are left out; a null
    condition counts as false.
    """
    code = sum((F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(labels)), F.lit(0))
    names = [f"n{i}" for i in range(1 << len(labels))]
    counted = rows.where(F.col(group).isNotNull()).select(F.col(group).alias("__group"), code.alias("__class")).groupBy("__group").agg(*[F.sum((F.col("__class") == i).cast("long")).alias(c) for i, c in enumerate(names)])
    counted = materialize(counted.withColumn("n", sum((F.col(c) for c in names), F.lit(0))), "split-groups")
    total = [x or 0 for x in counted.agg(*[F.sum(c) for c in names]).first()]
    large = F.col("n") * large_share >= sum(total)
    units = counted.where(large).select("__group", *names).collect()  # at most ``large_share`` rows
    placed, lacking = place([(r[0], list(r)[1:]) for r in units], [s for _, s in splits], total)
    kind = rows.schema[group].dataType.simpleString()
    table = rows.sparkSession.createDataFrame([(u, splits[s][0]) for u, s in placed.items()], f"__group {kind}, split string")
    out = counted.where(large).join(F.broadcast(table), "__group").select("__group", "split")

    digest = lambda c: F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}:"), c)), 1, 12), 16, 10).cast("long")
    vector = F.concat_ws("|", *names)
    few = counted.where(~large).select("__group", vector.alias("__vector"), digest(F.col("__group").cast("string")).alias("__at"), F.lit(0).alias("__none"))
    numbered = running_labels(few, "__vector", "__at", "__none", lambda _: F.lit(True), ["__group"], target_rows, "__prior", "__no")
    turn = F.col("__no") * GOLDEN + digest(F.col("__vector")) / float(1 << 48)
    u = turn - F.floor(turn)
    split, upto, whole = None, 0.0, sum(lacking) or 1.0
    for (name, share), lack in zip(splits, lacking, strict=True):
        upto += (lack if sum(lacking) else share) / whole
        split = F.when(u < upto, name) if split is None else split.when(u < upto, name)
    small = numbered.select("__group", split.otherwise(splits[-1][0]).alias("split"))
    return out.unionByName(small).withColumnRenamed("__group", group)

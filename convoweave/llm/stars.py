"""Links inside the buckets of a banding scheme, by stars instead of all pairs.

A bucket's centre is the member that shares buckets with the most others: in a
group of near copies that is the text they were copied from, whichever band is looked at.
All members are compared with the centre. Where they are not all in one component then, they are
dealt into buckets by the first items of their whole sets, rarest first: two sets of similarity ``t``
share one of any ``(1 - t) n + 1`` items in a fixed order. A pair of unlike components has a member outside
the component that most of its bucket is in, so those members are the next centres, more of them each time;
a member that was a centre is done. This is repeated until each bucket is in one component or
all such members were centres, so no pair that shares a bucket goes unresolved.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut_lineage, release
from .components import components
from .prefilter import keep_known, key_bitmap

Unfold = Callable[[Column], Column]

# Buckets of up to so many members are compared pair by pair at once.
SMALL_BUCKET = 6
# Centres of a bucket after the first star, and how many times as many there are in each round.
CENTRES, MORE = 8, 8
# Items are ranked by how many there are in one of so many slots, which any number of items fits in.
SLOTS = 1 << 18


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(
        F.col("a") != F.col("b")
    ).distinct()


def similar_pairs(pairs: DataFrame, sets: DataFrame, percent: int, unfold: Unfold) -> DataFrame:
    """Of ``(a, b)``, those with ``100 * |A & B| >= percent * |A | B|``, from ``sets (v, items, n)``.

    Sizes decide first; only the sets of what is left, by a bitmap of their vertices, are shuffled.
    """
    n = sets.select("v", "n")
    fits = cut_lineage(
        pairs.join(n.select(F.col("v").alias("a"), F.col("n").alias("na")), "a")
        .join(n.select(F.col("v").alias("b"), F.col("n").alias("nb")), "b")
        .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    )
    bitmap = key_bitmap(F.xxhash64("v"), fits.select(F.explode(F.array("a", "b")).alias("v")))
    used = keep_known(sets.select("v", "items"), F.xxhash64("v"), bitmap)
    both = F.size(F.array_intersect(unfold(F.col("items_a")), unfold(F.col("items_b"))))
    return (
        fits.join(used.select(F.col("v").alias("b"), F.col("items").alias("items_b")), "b")
        .join(used.select(F.col("v").alias("a"), F.col("items").alias("items_a")), "a")
        .where((100 + percent) * both >= percent * (F.col("na") + F.col("nb")))
        .select("a", "b")
    )


def shared_buckets(*members: DataFrame) -> DataFrame:
    """``(key, v, n, weight)`` of the buckets with two or more members, from tables ``(key, v)`` without a key in common.

    ``n`` counts the bucket's members, ``weight`` adds it up over the buckets of a member. Tables are
    taken one after the other, so that only the shuffles of one need room.
    """
    parts = []
    for table in members:
        counts = table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        counts = cut_lineage(counts)
        likely = keep_known(table, F.xxhash64("key"), key_bitmap(F.xxhash64("key"), counts))
        parts.append(cut_lineage(likely.join(counts, "key")))
        release(table.sparkSession)
    shared = reduce(DataFrame.union, parts)
    weights = shared.groupBy("v").agg(F.sum("n").alias("weight"))
    return cut_lineage(shared.join(weights, "v").select("key", "v", "n", "weight"))


def _small_pairs(shared: DataFrame) -> DataFrame:
    groups = shared.where(F.col("n") <= SMALL_BUCKET).groupBy("key").agg(
        F.sort_array(F.collect_list("v")).alias("vs")
    )
    firsts = groups.select(F.col("vs").alias("vs"), F.posexplode("vs").alias("i", "a"))
    return firsts.select("a", F.explode(F.expr("slice(vs, i + 2, size(vs))")).alias("b"))


def _owned(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``(key, v, *more, own, most, others)`` of the buckets of several components, from ``(key, v, *more)``.

    ``most`` is the component that most members are in, ``others`` are members outside it.
    """
    named = members.join(labels.select("v", F.col("label").alias("own")), "v", "left")
    named = cut_lineage(named.select(*members.columns, F.coalesce("own", "v").alias("own")))
    groups = named.groupBy("key", "own").agg(F.count(F.lit(1)).alias("m"))
    mixed = groups.groupBy("key").agg(
        F.sum("m").alias("n"), F.max("m").alias("top"), F.max_by("own", F.struct("m", "own")).alias("most")
    ).where(F.col("n") > F.col("top"))
    mixed = cut_lineage(mixed.select("key", "most", (F.col("n") - F.col("top")).alias("others")))
    likely = keep_known(named, F.xxhash64("key"), key_bitmap(F.xxhash64("key"), mixed))
    return cut_lineage(likely.join(mixed, "key").select(*named.columns, "most", "others"))


def _held(sets: DataFrame, unfold: Unfold) -> DataFrame:
    return sets.select("v", "size", F.explode(F.array_distinct(unfold(F.col("items")))).alias("item"))


def _prefix_buckets(starred: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, unfold: Unfold) -> DataFrame:
    """Members ``(key, v, size, rest)`` by the rarest items of their whole sets, where a star left several components.

    ``rest`` counts the member's items from the bucket's on. Two sets share no more than the lesser ``rest`` of the bucket of
    the first item they share, so a member that would need more with the smallest set there is left out: in a
    large group of copies with changes those that are too far from all others are not compared.
    """
    # The centre is in its bucket's component or not, but it is compared with all members already.
    mixed = _owned(starred.select(F.col("c").alias("key"), "v"), labels).select("key", "v")
    mixed = cut_lineage(mixed)
    wanted = mixed.select("v").distinct()
    used = keep_known(sets, F.xxhash64("v"), key_bitmap(F.xxhash64("v"), wanted)).join(wanted, "v", "left_semi")
    used = cut_lineage(used.select("v", F.col("n").alias("size"), "items"))
    # Items are counted by slot, so that the counts can be broadcast, and ranked where their set is: no item is written or dealt.
    slot = F.pmod(F.xxhash64("item"), F.lit(SLOTS)).cast("int").alias("slot")
    often = _held(used, unfold).groupBy(slot).agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    parts = int(used.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = _held(used.repartition(parts, "v"), unfold).select("*", slot)
    # Items of one set only come first and need no row; they count in the prefix.
    ranked = held.join(F.broadcast(often), "slot").groupBy("v", "size").agg(
        F.sort_array(F.collect_list(F.struct("often", "item"))).alias("ranked")
    )
    first = F.floor((F.col("size") * (100 - percent)) / 100).cast("int") + 1 - (F.col("size") - F.size("ranked"))
    prefix = cut_lineage(
        ranked.select("v", "size", F.size("ranked").alias("shared"), F.posexplode(F.slice("ranked", F.lit(1), F.greatest(first, F.lit(0)))).alias("at", "r"))
        .select("v", "size", (F.col("shared") - F.col("at")).alias("rest"), "r.item")
    )
    members = mixed.join(prefix, "v").groupBy(F.xxhash64("key", "item").alias("key"), "v").agg(
        F.max("size").alias("size"), F.max("rest").alias("rest")
    )
    least = members.groupBy("key").agg(F.min("size").alias("least"))
    other = F.greatest(F.col("least"), F.ceil(F.col("size") * percent / 100))
    return members.join(least, "key").where(_may_share(percent, "size", other, F.col("rest"))).drop("least")


def _may_share(percent: int, size: Column | str, other: Column | str, rest: Column) -> Column:
    """Whether sets of these sizes can be similar if they share no more than ``rest`` items."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (size, other))
    return (100 + percent) * rest >= percent * (a + b)


def similar_links(
    shared: DataFrame, sets: DataFrame, percent: int, unfold: Unfold = lambda items: items
) -> tuple[DataFrame, DataFrame]:
    """``(links, labels)``: the similar pairs ``(a, b)`` found in buckets, and the components they make.

    ``shared`` comes from ``shared_buckets``, ``sets (v, items)`` has the items of all its members, or
    what ``unfold`` makes them of, with their number ``n``. A bucket's members are never gathered: centres come
    from partial aggregates, comparisons from joins on the bucket.
    """
    if "n" not in sets.columns:
        sets = sets.withColumn("n", F.size("items"))
    large = shared.where(F.col("n") > SMALL_BUCKET)
    rank = F.struct(F.col("weight"), F.col("v"))
    centre = large.groupBy("key").agg(F.max_by("v", rank).alias("c"))
    starred = large.join(centre, "key").where(F.col("v") != F.col("c")).select("c", "v").distinct()
    starred = cut_lineage(starred)
    pairs = _small_pairs(shared).union(starred.select(F.col("c").alias("a"), F.col("v").alias("b")))
    links = cut_lineage(similar_pairs(_ordered(pairs), sets, percent, unfold))
    labels = cut_lineage(components(links))
    if starred.isEmpty():
        return links, labels
    left, centres = _owned(_prefix_buckets(starred, labels, sets, percent, unfold), labels), CENTRES
    while not left.isEmpty():
        outside = left.where(F.col("own") != F.col("most"))
        # About so many by a hash, and one in any case.
        chance = F.pmod(F.xxhash64("key", "v", F.lit(centres)), F.col("others")) < centres
        one = outside.groupBy("key").agg(F.max("v").alias("c"))
        chosen = cut_lineage(
            outside.where(chance).union(outside.join(one.withColumnRenamed("c", "v"), ["key", "v"], "left_semi").select(*left.columns))
            .select("key", F.col("v").alias("c"), F.col("own").alias("c_own"), F.col("size").alias("c_size"), F.col("rest").alias("c_rest"))
            .distinct()
        )
        pairs = left.join(chosen, "key").where(
            (F.col("own") != F.col("c_own")) & _may_share(percent, "size", "c_size", F.least("rest", "c_rest"))
        )
        more = cut_lineage(similar_pairs(_ordered(pairs.select(F.col("c").alias("a"), F.col("v").alias("b"))), sets, percent, unfold))
        if not more.isEmpty():
            links = cut_lineage(links.union(more).distinct())
            labels = cut_lineage(components(links))
        # Where all others were centres nothing is open.
        rest = left.where(F.col("others") > centres).select("key", "v", "size", "rest")
        done = chosen.select("key", F.col("c").alias("v"))
        left, centres = _owned(rest.join(done, ["key", "v"], "left_anti"), labels), centres * MORE
    return links, labels

"""Matching of lists that should agree: registry and archive, rooms of two stages, sets of marks of two pages."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import deque
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triscope.operators.layout import page_by_page


def by_path(registry: DataFrame, members: DataFrame, path: str, loose: Column) -> DataFrame:
    """Each registry row with the member of its path, found exactly or else under the loosened path; ``found`` says how.

    ``loose`` is an expression over ``path``; a loosened path shared by several members matches none of them.
    """
    m = members.select(F.col(path).alias("__m"), loose.alias("__l"))
    one = m.groupBy("__l").agg(F.count("*").alias("__n"), F.min("__m").alias("__only")).where("__n = 1")
    exact = registry.join(m.select("__m").distinct(), registry[path] == F.col("__m"), "left")
    both = exact.withColumn("__k", loose).join(one, F.col("__k") == F.col("__l"), "left")
    found = F.when(F.col("__m").isNotNull(), "exact").when(F.col("__only").isNotNull(), "loose").otherwise("none")
    return both.select(*(registry[c] for c in registry.columns), F.coalesce("__m", "__only").alias("member"), found.alias("found"))


def best_group(hits: DataFrame, item: str, group: str) -> DataFrame:
    """Of each item the group with the most hits; ties go to the smaller group."""
    n = hits.groupBy(item, group).agg(F.count("*").alias("n"))
    return n.groupBy(item).agg(F.max("n").alias("n_hits"), F.min_by(group, F.struct(-F.col("n"), F.col(group))).alias(group)).select(item, group, "n_hits")


def set_overlap(left: DataFrame, right: DataFrame, key: str, member: str, least: int) -> DataFrame:
    """left, right, common, ratio of the pairs of sets that share ``least`` members or more; ratio is common over the union.

    Sets are rows of key and member. Members are ordered by rarity, and of a set with n only the first ``n - least + 1`` make
    candidates: two sets with ``least`` in common share one of those. The candidates' members are then counted; none is lost.
    """
    from pyspark.sql import Window as W

    a, b = left.select(F.col(key).alias("k"), member).distinct(), right.select(F.col(key).alias("k"), member).distinct()
    rarity = a.unionByName(b).groupBy(member).agg(F.count("*").alias("__f"))

    def ranked(df: DataFrame) -> DataFrame:
        by = W.partitionBy("k")
        return df.join(rarity, member).withColumn("size", F.count("*").over(by)).withColumn("place", F.row_number().over(by.orderBy("__f", member)))

    x, y = ranked(a), ranked(b)
    prefix = lambda df: df.where(F.col("place") <= F.col("size") - least + 1)
    l, r = prefix(x).select(F.col("k").alias("left"), member, F.col("size").alias("n_left")), prefix(y).select(F.col("k").alias("right"), member, F.col("size").alias("n_right"))
    pairs = l.join(r, member).select("left", "right", "n_left", "n_right").distinct()
    members = pairs.join(a.withColumnRenamed("k", "left"), "left").join(b.withColumnRenamed("k", "right"), ["right", member])
    counted = members.groupBy("left", "right", "n_left", "n_right").agg(F.count("*").alias("common")).where(F.col("common") >= least)
    return counted.select("left", "right", "common", (F.col("common") / (F.col("n_left") + F.col("n_right") - F.col("common"))).alias("ratio"))


def with_pieces(df: DataFrame, group: list[str], size: str, tolerance: float) -> DataFrame:
    """The rows with ``__piece``: each group cut, by size, where the next size is further off than ``tolerance`` of itself.

    No two rows of different pieces are within the tolerance of either of them. Sizes are positive. A bucket spans less than one such
    gap, so only the least and greatest size of each bucket are looked at, and no group is sorted as a whole.
    """
    from pyspark.sql import Window as W

    if tolerance >= 1:
        return df.withColumn("__piece", F.lit(0))
    bucket = F.floor(F.log(F.col(size).cast("double")) / max(-math.log1p(-tolerance), 1e-6)).cast("bigint")
    rows = df.withColumn("__bucket", bucket)
    ends = rows.groupBy(*group, "__bucket").agg(F.min(size).alias("__least"), F.max(size).alias("__most"))
    w = W.partitionBy(*group).orderBy("__bucket")
    gap = (F.col("__least") - F.lag("__most").over(w)).cast("double") / F.col("__least").cast("double")
    cut = F.coalesce(gap > tolerance + 1e-9, F.lit(False)).cast("int")  # by a margin, so that rounding cuts nothing
    pieces = ends.withColumn("__cut", cut).withColumn("__piece", F.sum("__cut").over(w).cast("int"))
    named = pieces.select(*(F.col(c).alias(f"__g{i}") for i, c in enumerate(group)), F.col("__bucket").alias("__b"), "__piece")
    same = [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(group)]
    return rows.join(named, [*same, F.col("__bucket") == F.col("__b")]).select(*df.columns, "__piece")


def nearest_free(left: list[tuple], right: list[tuple], near: Callable[[float, float], bool]) -> list[tuple]:
    """(key, key): each (key, size) on the left, in order, with the free right one nearest in size, the earlier on a tie, if ``near``.

    The right sizes are sorted once and taken ones are stepped over, so n rows take n log n steps.
    """
    sizes: dict = {}
    for key, size in right:
        sizes.setdefault(size, []).append(key)
    order = sorted(sizes)
    queues, place = [deque(sizes[s]) for s in order], {key: i for i, (key, _) in enumerate(right)}
    up, down = list(range(len(order) + 1)), list(range(len(order) + 1))  # up: next place with a free one; down: shifted by one, 0 is none

    def root(to: list[int], i: int) -> int:
        while to[i] != i:
            to[i] = to[to[i]]
            i = to[i]
        return i

    out = []
    for key, size in left:
        at = bisect_left(order, size)
        above, below = root(up, at), root(down, at) - 1
        found = [(abs(order[i] - size), place[queues[i][0]], i) for i in (above, below) if 0 <= i < len(order)]
        if not found:
            continue
        i = min(found)[2]
        if near(size, order[i]):
            out.append((key, queues[i].popleft()))
            if not queues[i]:
                up[i], down[i + 1] = i + 1, i
    return out


def greedy_areas(left: DataFrame, right: DataFrame, group: list[str], key: str, area: str, order: str, tolerance: float = 0.03) -> DataFrame:
    """group, left_key, right_key: rows matched one to one by nearest area within a relative tolerance, in the order of the left rows.

    Each left row takes the nearest free right one (the earlier on a tie), so the result depends on the order by its meaning. Areas
    that are not positive match nothing. Groups are cut at gaps that no pair can bridge; a piece without such a gap goes to one task.
    """
    kind = left.schema[key].dataType.simpleString()

    def match(rows: list[tuple]) -> list[tuple]:
        a, b = (sorted((r[1:] for r in rows if r[0] == side), key=lambda r: (r[2], r[0])) for side in (0, 1))
        return nearest_free([r[:2] for r in a], [r[:2] for r in b], lambda x, y: abs(y - x) / x <= tolerance)

    side = lambda df, n: df.where((F.col(area) > 0) & ~F.isnan(F.col(area).cast("double")) & F.col(order).isNotNull()).select(*group, F.lit(n).alias("__side"), F.col(key).alias("__key"), F.col(area).alias("__area"), F.col(order).alias("__order"))
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]
    both = with_pieces(side(left, 0).unionByName(side(right, 1)), group, "__area", tolerance)
    return page_by_page(both, [*group, "__piece"], ["__side", "__key", "__area", "__order"], match, [("left_key", kind, arrow), ("right_key", kind, arrow)]).drop("__piece")


class _Free:
    """Items by size, the nearest free one found by stepping over those that are taken."""

    def __init__(self, items: list[tuple], taken: set):
        by_size: dict = {}
        for order, size in items:
            by_size.setdefault(size, deque()).append(order)
        self.sizes, self.taken = sorted(by_size), taken
        self.queues = [by_size[s] for s in self.sizes]
        self.up, self.down = list(range(len(self.sizes) + 1)), list(range(len(self.sizes) + 1))

    def _root(self, to: list[int], i: int, step: Callable[[int], int]) -> int | None:
        """The next size on one side with a free item."""
        while True:
            j = i
            while to[j] != j:
                to[j] = to[to[j]]
                j = to[j]
            at = step(j)
            if not 0 <= at < len(self.sizes):
                return None
            q = self.queues[at]
            while q and q[0] in self.taken:
                q.popleft()
            if q:
                return at
            self.up[at], self.down[at + 1] = at + 1, at
            i = j

    def nearest(self, size: float) -> tuple | None:
        """(difference, order, size) of the nearest free item, the earlier on a tie."""
        at = bisect_left(self.sizes, size)
        ends = (self._root(self.up, at, lambda j: j), self._root(self.down, at, lambda j: j - 1))
        return min(((abs(self.sizes[i] - size), self.queues[i][0], self.sizes[i]) for i in ends if i is not None), default=None)


def match_rest(left: list[tuple], right: list[tuple], tolerance: float) -> list[tuple[int, int]]:
    """(place, place): each (name, size) on the left, in order, with a free right one within a tolerance of the larger size: the
    nearest of its own name, else the nearest of any."""
    taken: set[int] = set()
    by_name: dict = {}
    for i, (name, size) in enumerate(right):
        by_name.setdefault(name, []).append((i, size))
    named = {n: _Free(items, taken) for n, items in by_name.items() if n is not None}
    every, out = _Free([(i, size) for i, (_, size) in enumerate(right)], taken), []
    for k, (name, size) in enumerate(left):
        for free in (named.get(name), every):
            best = free.nearest(size) if free else None
            if best and best[0] <= tolerance * max(size, best[2]):
                taken.add(best[1])
                out.append((k, best[1]))
                break
    return out


def diff_lists(left: DataFrame, right: DataFrame, group: list[str], key: str, name: str, area: str, order: str, tolerance: float = 0.03) -> DataFrame:
    """group, left_order, right_order, how: two lists that should agree. Rows of equal key are matched first (``key``; repeated keys by
    their order), then what is left by area within a tolerance of the larger one, the same name before another (``area``); the rest is
    ``removed`` or ``added``. ``order`` tells the rows of a list apart. Null keys match nothing; null or non-positive areas nothing by area.
    """
    from pyspark.sql import Window as W

    g = [F.col(c) for c in group]
    rank = F.row_number().over(W.partitionBy(*group, key).orderBy(order))
    side = lambda df, s: df.select(*g, F.col(key).alias("__key"), F.col(name).alias("__name"), F.col(area).cast("double").alias("__area"), F.col(order).alias("__order"), F.when(F.col(key).isNotNull(), rank).alias("__rank")).withColumn("__side", F.lit(s))
    a, b = side(left, 0), side(right, 1)
    both = a.unionByName(b)
    paired = both.where("__key is not null").groupBy(*group, "__key", "__rank").agg(F.max(F.when(F.col("__side") == 0, F.col("__order"))).alias("left_order"), F.max(F.when(F.col("__side") == 1, F.col("__order"))).alias("right_order"))
    by_key = paired.where("left_order is not null and right_order is not null").select(*group, "left_order", "right_order", F.lit("key").alias("how"))
    used = by_key.select(*group, F.explode(F.array(F.struct(F.lit(0).alias("__side"), F.col("left_order").alias("__order")), F.struct(F.lit(1).alias("__side"), F.col("right_order").alias("__order")))).alias("u")).select(*group, "u.__side", "u.__order")
    rest = both.join(used, [*group, "__side", "__order"], "left_anti")
    kind = left.schema[order].dataType.simpleString()
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]

    def match(rows: list[tuple]) -> list[tuple]:
        l, r = (sorted((x[1:] for x in rows if x[0] == s), key=lambda x: x[0]) for s in (0, 1))
        return [(l[i][0], r[j][0]) for i, j in match_rest([x[1:] for x in l], [x[1:] for x in r], tolerance)]

    sized = rest.where((F.col("__area") > 0) & ~F.isnan("__area"))
    pieces = with_pieces(sized, group, "__area", tolerance)  # a gap wider than the tolerance of the larger size parts what can't match
    by_area = page_by_page(pieces, [*group, "__piece"], ["__side", "__order", "__name", "__area"], match, [("left_order", kind, arrow), ("right_order", kind, arrow)]).drop("__piece").withColumn("how", F.lit("area"))
    taken = by_area.select(*group, F.explode(F.array(F.struct(F.lit(0).alias("__side"), F.col("left_order").alias("__order")), F.struct(F.lit(1).alias("__side"), F.col("right_order").alias("__order")))).alias("u")).select(*group, "u.__side", "u.__order")
    over = rest.join(taken, [*group, "__side", "__order"], "left_anti")
    one = lambda s: F.when(F.col("__side") == s, F.col("__order"))
    alone = over.select(*group, one(0).alias("left_order"), one(1).alias("right_order"), F.when(F.col("__side") == 0, "removed").otherwise("added").alias("how"))
    return by_key.unionByName(by_area).unionByName(alone)


def similar_sets(left: DataFrame, right: DataFrame, key: str, member: str, least: float = 0.5, veto: Column | None = None) -> DataFrame:
    """left, right, common, share: for each set on the left those on the right with the largest share in common, ties kept.

    The share is common members over the smaller set, ``least`` or more. ``veto`` is a condition over left and right that rules pairs out.
    Of the smaller set of a pair only the rarest members that it can't do without make candidates; none is lost.
    """
    from pyspark.sql import Window as W

    a, b = left.select(F.col(key).alias("k"), F.col(member).alias("m")).distinct(), right.select(F.col(key).alias("k"), F.col(member).alias("m")).distinct()
    rarity = a.unionByName(b).groupBy("m").agg(F.count("*").alias("f"))

    def ranked(df: DataFrame) -> DataFrame:
        by = W.partitionBy("k")
        return df.join(rarity, "m").withColumn("n", F.count("*").over(by)).withColumn("place", F.row_number().over(by.orderBy("f", "m")))

    needed = F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1
    x, y = ranked(a).select("m", F.col("k").alias("left"), F.col("n").alias("n_left"), needed.alias("l")), ranked(b).select("m", F.col("k").alias("right"), F.col("n").alias("n_right"), needed.alias("r"))
    small_left = x.where("l").join(y, "m").where("n_left <= n_right")
    small_right = x.join(y.where("r"), "m").where("n_left > n_right")
    pairs = small_left.unionByName(small_right).select("left", "right", "n_left", "n_right").distinct()
    pairs = pairs if veto is None else pairs.where(~F.coalesce(veto, F.lit(False)))
    members = pairs.join(a.withColumnsRenamed({"k": "left"}), "left").join(b.withColumnsRenamed({"k": "right"}), ["right", "m"])
    share = F.col("common") / F.least("n_left", "n_right")
    counted = members.groupBy("left", "right", "n_left", "n_right").agg(F.count("*").alias("common")).withColumn("share", share).where(F.col("share") >= least - 1e-9)
    best = counted.groupBy("left").agg(F.max("share").alias("best"))
    return counted.join(best, "left").where("share = best").select("left", "right", "common", "share")


def same_stems(a: Column, b: Column, stem: int = 6, least: float = 0.6) -> Column:
    """Whether two names say the same: one's stems within the other's, or alike by ``least``; a name without words says anything."""
    stems = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(F.translate(F.lower(F.coalesce(c, F.lit(""))), "ё", "е"), F.lit("([а-яa-z]{2,})"), F.lit(1)), lambda w: F.substring(w, 1, stem)))
    x, y = stems(a), stems(b)
    common = F.size(F.array_intersect(x, y))
    return (common == F.least(F.size(x), F.size(y))) | (common / F.greatest(F.lit(1), F.size(F.array_union(x, y))) >= least)


def once_printed(words: DataFrame, page: list[str], order: str, text: str, within: float = 3.0, back: int = 40) -> DataFrame:
    """Words of a page without those printed over an equal one among the ``back`` words before, at most ``within`` away.

    Words have x0, y0. Looks at the words themselves, so a word printed three times leaves one.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy(*page).orderBy(order).rowsBetween(-back, -1)
    seen = F.collect_list(F.struct(F.col(text).alias("t"), "x0", "y0")).over(w)
    twice = F.exists(seen, lambda s: (s["t"] == F.col(text)) & (F.abs(s["x0"] - F.col("x0")) < within) & (F.abs(s["y0"] - F.col("y0")) < within))
    return words.withColumn("__twice", twice).where(~F.coalesce("__twice", F.lit(False))).drop("__twice")


def contiguous_portions(done: DataFrame, index: str, flag: str, portion: int) -> DataFrame:
    """first, last of the runs of undone indexes, cut into portions."""
    from triscope.operators.sequences import islands

    runs = islands(done.where(~F.col(flag)).withColumn("__all", F.lit(0)), ["__all"], index)
    parts = runs.withColumn("a", F.explode(F.sequence(F.col("first").cast("bigint"), F.col("last").cast("bigint"), F.lit(portion).cast("bigint"))))
    return parts.select(F.col("a").alias("first"), F.least(F.col("a") + portion - 1, F.col("last").cast("bigint")).alias("last"))


def seeded_sample(df: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows of each group, the same for the same seed whatever the order of the input."""
    from pyspark.sql import Window as W

    w = W.partitionBy(group).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")  # ranks are cut before they move

"""Byte-balanced shards by histogram sort (operator 2).

Every row has a key of two 63-bit hashes: first of its group column, then of its id.
A round counts exact bytes and rows below all candidate boundaries that divide the
intervals still open around the wanted splitters (a radix digit of the key per
round), and each splitter settles as soon as a boundary lies within ``tolerance`` of
its share.  So rounds read a narrow table of keys and sizes only, and the driver
holds one histogram of bounded size.  Then one exchange deals the rows by the splitters,
each shard to as many partitions as its bytes take (by a hash of the whole key), so no
task holds a whole shard and nothing is sampled.

Rows of equal groups are neighbours and share a shard unless the group is so large
that the law of equal sizes needs it cut; the second hash then gives the boundaries.
Places in a shard are counted where the rows lie: a running number inside each sorted
partition, plus one offset per partition and shard.

Defined results: a null group or id hashes like any value and a null size counts as
``extra_bytes`` only; rows equal in group and id are indivisible neighbours; an empty
table gives no rows; input columns named size, shard or slot, in any case, give way to the
result's, and other columns stay whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.llm import common

#: Digits of a 63-bit key, from the top.
WIDTHS = (12, 12, 12, 12, 15)
SPAN = 1 << 63


def _key(*columns) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 1)


class _Interval:
    """Where a splitter still may lie: all keys that share the digits seen so far."""

    def __init__(self, target: float, allowed: float):
        self.target, self.allowed, self.below = target, allowed, 0
        self.word, self.depth, self.prefix = 0, 0, 0
        self.first: int | None = None
        self.found: tuple[int, int] | None = None


def splitters(keys: DataFrame, total: int, n_shards: int, tolerance: float) -> list[tuple[int, int]]:
    """Boundaries (first hash, second hash) of shards 1 to n-1; rows at or above belong there.

    ``keys`` has columns a, b (63-bit keys) and size, ``total`` bytes in all.
    """
    all_open = [_Interval(total * j / n_shards, tolerance * total / n_shards) for j in range(1, n_shards)]
    while open_ := [x for x in all_open if x.found is None]:
        wanted = None
        groups: dict[tuple, list[_Interval]] = {}
        for x in open_:
            groups.setdefault((x.word, x.depth, x.first, x.prefix), []).append(x)
        counts: dict[tuple, list] = {}
        for word, depth in {(g[0], g[1]) for g in groups}:
            key = F.col("b" if word else "a")
            used = sum(WIDTHS[:depth])
            left = 63 - used - WIDTHS[depth]
            mine = [g for g in groups if g[:2] == (word, depth)]
            head = F.shiftright(key, 63 - used) if used else F.lit(0).cast("long")
            lead = F.col("a") if word else F.lit(-1).cast("long")
            wanted = [(lead == F.lit(-1 if g[2] is None else g[2]).cast("long")) & (head == F.lit(g[3]).cast("long")) for g in mine]
            rows = keys.where(reduce(lambda a, b: a | b, wanted)).groupBy(lead.alias("lead"), head.alias("head"), F.shiftright(key, left).bitwiseAND((1 << WIDTHS[depth]) - 1).alias("digit")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
            # At most 2^width rows for each open splitter.
            for r in rows.collect():
                counts.setdefault((word, depth, None if r["lead"] == -1 else r["lead"], r["head"]), []).append((r["digit"], r["bytes"], r["rows"]))
        for group, members in groups.items():
            cells = sorted(counts.get(group, []))
            for x in members:
                _settle(x, cells)
    return [x.found for x in all_open]


def _settle(x: _Interval, cells: list[tuple[int, int, int]]) -> None:
    width = WIDTHS[x.depth]
    left = 63 - sum(WIDTHS[: x.depth + 1])

    def boundary(digit: int) -> tuple[int, int]:
        at = ((x.prefix << width) + digit) << left
        if not x.word:
            return at, 0
        return (x.first, at) if at < SPAN else (x.first + 1, 0)

    below = x.below
    for digit, size, rows in cells:
        if below + size < x.target:
            below += size
            continue
        low, high = x.target - below, below + size - x.target
        if low <= x.allowed and low <= high:
            x.found = boundary(digit)
        elif high <= x.allowed:
            x.found = boundary(digit + 1)
        elif rows == 1 or (x.word and x.depth == len(WIDTHS) - 1):
            x.found = boundary(digit if low <= high else digit + 1)
        else:
            x.below, x.prefix, x.depth = below, (x.prefix << width) + digit, x.depth + 1
            if x.depth == len(WIDTHS):
                x.word, x.depth, x.first, x.prefix = 1, 0, x.prefix, 0
        return
    x.found = boundary(cells[-1][0] + 1) if cells else (0, 0)


def _number(bounds: list[tuple[int, int]]) -> Column:
    """How many boundaries lie at or below the row's key (a, b)."""
    bounds = [x for x in bounds if x[0] < SPAN]  # others lie above all keys
    pairs = F.lit([x for x, _ in bounds]), F.lit([y for _, y in bounds])
    below = F.zip_with(*pairs, lambda x, y: (x < F.col("a")) | ((x == F.col("a")) & (y <= F.col("b"))))
    return F.size(F.filter(below, lambda x: x)) if bounds else F.lit(0)


def shard(df: DataFrame, group: str, row_id: str, n_shards: int = 16, extra_bytes: int = 1, tolerance: float = 0.001, part_bytes: int = 32 << 20) -> DataFrame:
    """Deal rows into ``n_shards`` shards of near-equal UTF-8 bytes of ``group``.

    Returns the rows with ``size`` (bytes plus ``extra_bytes``), ``shard`` and ``slot``,
    its place in the shard from 0.
    """
    # The whole input row travels as one column, so its names meet no others.
    own = [common.column(c) for c in df.columns if c.lower() not in ("size", "shard", "slot")]
    keyed = df.select(F.struct(*own).alias("row"), (F.coalesce(F.octet_length(group), F.lit(0)).cast("long") + extra_bytes).alias("size"), _key(group).alias("a"), _key(row_id).alias("b"))
    keys = common.stored(keyed.select("a", "b", "size"), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    number = _number(splitters(keys, total, n_shards, tolerance))
    common.forget(keys)
    parts = max(1, -(-total // (n_shards * part_bytes)))
    dealt = keyed.select("row", "size", "a", "b", number.alias("shard"), F.pmod(F.xxhash64("a", "b"), F.lit(parts)).alias("part"))
    # A partition for each part of a shard: by a hash some would hold several, and others none.
    dealt = dealt.repartitionById(n_shards * parts, (F.col("shard") * parts + F.col("part")).cast("int")).sortWithinPartitions("shard", "a", "b")
    dealt = common.stored(dealt.select("row", "size", "shard", F.monotonically_increasing_id().alias("at")), "shards")
    dealt = dealt.select("row", "size", "shard", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("place"))
    # A row for each partition of the exchange and shard in it: n_shards * parts at most.
    held = dealt.groupBy("part", "shard").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    ahead = held.select("part", "shard", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n") - F.col("first")).alias("ahead"))
    return dealt.join(F.broadcast(ahead), ["part", "shard"]).select("row.*", "size", "shard", (F.col("place") + F.col("ahead")).alias("slot"))

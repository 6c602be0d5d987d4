"""Problem 9: filling containers of fixed capacity.

Items are dealt by a hash of their key into blocks of bounded size, and each block is packed on its
own, which costs at most about one half-empty container a block. In a block:

1. items over the capacity are cut into full containers and a rest;
2. large items (over 1/8 of the capacity) are put into groups of equal cardinality, rounded up to
   the largest of their group (linear grouping);
3. the fewest containers for these few sizes are a linear program over all configurations; it is
   solved by column generation, the most valuable configuration of each step being an exact
   knapsack over the capacity, and every configuration is used as often as the solution says, less
   the fractions;
4. actual items, largest of the group first, take the places of the rounded ones; the last place of
   a container takes the largest item that fits the room which the rounding left, and so on until
   none fits;
5. what is left, small items mostly, goes by falling size into the container that it leaves with the
   least room.

Cases: null, empty and zero-size items take no room and are dealt over the block's containers in
turn; repeated keys are separate items; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUPS, LARGE, BLOCK = 12, 8, 20_000
#: Steps of the column generation at most; what an unfinished solution leaves goes to step 5.
STEPS = 2000


def _most_valuable(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of the highest value: how many of each size, by an exact knapsack."""
    best = np.zeros(capacity + 1)
    taken = []
    for s, v in zip(sizes, values, strict=True):
        take = np.zeros(capacity + 1, np.int64)
        if v > 1e-12:
            before = best.copy()
            for k in range(1, capacity // s + 1):
                more = before[: capacity + 1 - k * s] + k * v
                at = more > best[k * s :] + 1e-12
                best[k * s :][at] = more[at]
                take[k * s :][at] = k
        taken.append(take)
    out, room = np.zeros(len(sizes)), capacity
    for i in range(len(sizes) - 1, -1, -1):
        out[i] = taken[i][room]
        room -= int(out[i]) * sizes[i]
    return float(best[capacity]), out


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and how often each is used in the best fractional solution, rounded down."""
    m = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    inverse, need = np.linalg.inv(basis), np.array(counts, float)
    x = inverse @ need
    for step in range(1, STEPS + 1):
        value, column = _most_valuable(sizes, np.ones(m) @ inverse, capacity)
        if value <= 1 + 1e-7:
            break
        d = inverse @ column
        ratio = np.full(m, np.inf)
        ratio[d > 1e-9] = x[d > 1e-9] / d[d > 1e-9]
        q = int(np.argmin(ratio))
        times = ratio[q]
        x -= times * d
        x[q] = times
        basis[:, q] = column
        row = inverse[q] / d[q]
        inverse -= np.outer(d, row)
        inverse[q] = row
        if step % 50 == 0:  # rounding errors do not add up
            inverse = np.linalg.inv(basis)
            x = inverse @ need
    return [(tuple(int(n) for n in basis[:, j]), int(x[j] + 1e-6)) for j in range(m)]


class _Sizes:
    """Things by size, with a bit set of the sizes there are."""

    def __init__(self):
        self.of: dict[int, list] = {}
        self.present = 0

    def add(self, size: int, thing) -> None:
        if size in self.of:
            self.of[size].append(thing)
        else:
            self.of[size] = [thing]
            self.present |= 1 << size

    def _pop(self, size: int):
        stack = self.of[size]
        thing = stack.pop()
        if not stack:
            del self.of[size]
            self.present &= ~(1 << size)
        return size, thing

    def largest(self, limit: int):
        """The largest of at most ``limit``, or None."""
        some = self.present & (1 << limit + 1) - 1
        return self._pop(some.bit_length() - 1) if some else None

    def smallest(self, limit: int):
        """The smallest of at least ``limit``, or None."""
        some = self.present >> limit
        return self._pop(limit + (some & -some).bit_length() - 1) if some else None


def pack(sizes: list[int], capacity: int) -> tuple[list[list[tuple[int, int, int]]], int]:
    """Containers as lists of ``(item, first, length)``; second, how many of them there are."""
    full: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []  # length, item, first
    empty = []
    for i, n in enumerate(sizes):
        at = 0
        while n - at >= capacity:
            full.append([(i, at, capacity)])
            at += capacity
        if n > at:
            rest.append((n - at, i, at))
        elif not n:
            empty.append(i)
    rest.sort(key=lambda x: (-x[0], x[1]))
    left = _Sizes()
    for n, i, a in reversed(rest):
        left.add(n, (i, a))
    large = [n for n, _, _ in rest if n * LARGE > capacity]
    bins: list[list[tuple[int, int, int]]] = []
    rooms = _Sizes()
    if large:
        g = -(-len(large) // GROUPS)
        counts: dict[int, int] = {}
        for k in range(0, len(large), g):
            counts[large[k]] = counts.get(large[k], 0) + len(large[k : k + g])
        tops = list(counts)
        for config, times in sorted(configurations(tops, list(counts.values()), capacity), reverse=True):
            places = [s for s, n in zip(tops, config, strict=True) for _ in range(n)]
            for _ in range(times):
                content, room = [], capacity
                for s in [*places[:-1], capacity]:
                    while (got := left.largest(min(s, room))) is not None:
                        n, (i, a) = got
                        content.append((i, a, n))
                        room -= n
                        if s < capacity:
                            break
                if content:
                    if room:
                        rooms.add(room, len(bins))
                    bins.append(content)
    while (got := left.largest(capacity)) is not None:
        n, (i, a) = got
        found = rooms.smallest(n)
        if found is None:
            room, b = capacity, len(bins)
            bins.append([])
        else:
            room, b = found
        bins[b].append((i, a, n))
        if room > n:
            rooms.add(room - n, b)
    bins = full + bins
    if empty and not bins:
        bins.append([])
    for k, i in enumerate(empty):
        bins[k % len(bins)].append((i, 0, 0))
    return bins, len(bins)


def fill_containers(items: DataFrame, packs: DataFrame, key: str, size: str, block: int = BLOCK, rows: int | None = None) -> DataFrame:
    """``(pack_name, container_id, key, piece_no, start_token, tokens)`` for every item and pack.
    ``items`` needs ``key`` and an integral ``size``; ``packs`` is a small table of capacities; ``rows``
    is the number of items, if known without computing their sizes."""
    kinds_of_packs = [(r["pack_name"], int(r["capacity_tokens"])) for r in packs.limit(1001).collect()]
    if len(kinds_of_packs) > 1000:
        raise ValueError("packs: a small table is expected")
    if any(c < 1 for _, c in kinds_of_packs):
        raise ValueError("packs: a capacity under 1 holds nothing")
    kind = items.schema[key].dataType.simpleString()
    packed = F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(c).alias("cap")) for n, c in kinds_of_packs])
    blocks = max(1, -(-(items.count() if rows is None else rows) // block))
    src = items.select(F.col(key).alias("_k"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("_n"))
    src = src.withColumn("_b", F.pmod(F.xxhash64("_k", "_n"), F.lit(blocks)).cast("int"))
    src = src.withColumn("_p", F.explode(packed)).select("_k", "_n", "_b", "_p.pack_name", "_p.cap")
    src = src.repartition("pack_name", "_b").sortWithinPartitions("pack_name", "_b", "_k", "_n")

    def flush(name, cap, b, part, keys, sizes):
        bins, _ = pack(sizes, cap)
        flat = [(c, i, a, n) for c, content in enumerate(bins) for i, a, n in content]
        no: dict[int, int] = {}
        pieces = {}
        for i, a in sorted((i, a) for _, i, a, _ in flat):
            no[i] = pieces[i, a] = no.get(i, 0) + 1
        first = (b << 36) + (part << 28)
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * len(flat), pa.string()), pa.array([first + c for c, _, _, _ in flat], pa.int64()), pa.array([keys[i] for _, i, _, _ in flat], kinds[0]), pa.array([pieces[i, a] for _, i, a, _ in flat], pa.int32()), pa.array([a for _, _, a, _ in flat], pa.int64()), pa.array([n for *_, n in flat], pa.int64())],
            names=["pack_name", "container_id", "_k", "piece_no", "start_token", "tokens"],
        )

    kinds: list[pa.DataType] = []

    def work(batches):
        now, keys, sizes, part = None, [], [], 0
        for batch in batches:
            kinds[:] = [batch.column(0).type]
            for k, n, b, name, cap in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (name, cap, b) or len(keys) >= 4 * block:  # a block that came out too large is closed and goes on as another
                    if keys:
                        yield flush(*now, part, keys, sizes)
                    part = part + 1 if now == (name, cap, b) else 0
                    now, keys, sizes = (name, cap, b), [], []
                keys.append(k)
                sizes.append(n)
        if keys:
            yield flush(*now, part, keys, sizes)

    return src.mapInArrow(work, f"pack_name string, container_id bigint, _k {kind}, piece_no int, start_token bigint, tokens bigint").withColumnRenamed("_k", key)


def fill_report(placed: DataFrame, packs: DataFrame, key: str) -> DataFrame:
    """Per pack: containers, tokens, share of room used."""
    c = placed.groupBy("pack_name", "container_id").agg(F.sum("tokens").alias("t"))
    r = c.groupBy("pack_name").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    return r.join(F.broadcast(packs.limit(1000)), "pack_name").select("pack_name", "containers", "tokens", "fullest", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 4).alias("used"))

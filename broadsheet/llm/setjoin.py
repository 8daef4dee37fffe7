"""An exact set-similarity join: sets of word shingles, Jaccard of threshold or more, whole texts.

Units (documents, or lines of documents) with equal sets are one class, keyed by a 64-bit hash of the set; members of a
class need no comparison. The stages, each a written table:

survey     document frequencies of shingles over all units, in a fixed number of counters, and each class's bitmap
prefixes   each class orders its shingles by rarity and sends its prefix (n - ceil(t*n) + 1 shingles: two sets that reach
           the threshold share one) to the shingles' buckets, as packed arrays
tiles      a bucket finds shingles that several classes share; equal member lists are one tile
stars      in a tile, every member meets the pivot, the member that comes first
rest       members that the stars don't settle meet each other, block by block, inside size bands of the family of tiles
may        hashed bitmaps bound a pair's overlap from above by bit counts
exact      what may reach the threshold is intersected exactly, as sorted arrays

Stars keep a large group of near copies from being expanded into all its pairs. Nothing is sampled or capped: the sketch
steers the order, on which the result doesn't depend.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, forget, lean, lean_group, mix, settle, width
from .components import components

#: Counters of the sketch (4 MB), whatever the input: rare shingles share counters then, which lifts all of them alike, while
#: the frequent ones, which a prefix must not hold, still stand out. Bits of the set of active classes: sixteen for each
#: class, between these bounds (2 and 32 MB).
SKETCH, ACTIVE = 1 << 20, (24, 28)
_CHUNK = 1 << 14
#: What the driver reads of bounded size comes in so many jobs, not in one for each partition of a shuffle.
FETCHES = 8
#: Rows of a block of a family; a row goes to each pair of blocks that has its own, so blocks of some size keep copies few.
TILE = 4096
#: Up to so many likely partners of a member in one group are all met at once.
PARTNERS = 8
_U = np.uint64


class Units:
    """Distinct shingles of a run of units: unit i has hashes[at[i]:at[i+1]] (48 bits each, sorted), n[i] of them, and set hash key[i]."""

    def __init__(self, hashes: np.ndarray, at: np.ndarray):
        """Shingle hashes of up to 65,535 units that all have some, in order of units."""
        unit = np.repeat(np.arange(len(at) - 1, dtype=_U), np.diff(at))
        packed = np.sort(unit << _U(48) | hashes >> _U(16))
        fresh = np.ones(len(packed), bool)
        fresh[1:] = packed[1:] != packed[:-1]
        packed = packed[fresh]
        self.hashes = packed & _U((1 << 48) - 1)
        self.unit = (packed >> _U(48)).astype(np.int64)
        self.at = np.searchsorted(self.unit, np.arange(len(at)))
        self.n = np.diff(self.at)
        self.key = mix(np.add.reduceat(mix(self.hashes + _U(11)), self.at[:-1]) + self.n.astype(_U)).view(np.int64) if len(self.n) else np.zeros(0, np.int64)

    def prefix(self, counts: np.ndarray, percent: int) -> np.ndarray:
        """Places in hashes of each unit's rarest shingles, as many as the threshold needs."""
        rarity = np.minimum(counts[(self.hashes % _U(SKETCH)).astype(np.int64)], (1 << 20) - 1).astype(_U)
        # shingles of one rarity stay in the order of their hashes, which all units share; places below 2**28 ride in the key
        key = self.unit.astype(_U) << _U(48) | rarity << _U(28)
        order = (np.sort(key | np.arange(len(key), dtype=_U)) & _U((1 << 28) - 1)).astype(np.int64) if len(key) < 1 << 28 else np.argsort(key, kind="stable")
        rank = np.arange(len(order)) - self.at[self.unit]
        return order[rank < (self.n - -(-self.n * percent // 100) + 1)[self.unit]]


#: From a batch: runs of units with the numbers of the rows that they come from, and more columns for the unit table.
Reader = Callable[[pa.RecordBatch], Iterator[tuple[Units, dict]]]


def survey(docs: DataFrame, read: Reader, extra: dict[str, pa.DataType], more: Callable, signed: bool = True) -> DataFrame:
    """One pass over the texts: a row (c, n, bits, extra...) for each unit, and pieces of the sketch (piece, part, counts).

    more(batch, extra columns of the reader) gives the arrays of `extra` for the units of a run. A class has its bitmap once
    for each partition, if it is signed at all.
    """
    names = ["piece", "part", "counts", "c", "n", "bits", *extra]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), *extra.values()]
    schema = pa.schema(list(zip(names, kinds)))

    def count(batches):
        total = np.zeros(SKETCH, np.int64)
        seen: set[int] = set()
        for b in batches:
            for units, found in read(b):
                total += np.bincount((units.hashes % _U(SKETCH)).astype(np.int64), minlength=SKETCH)
                m = len(units.n)
                bits = [bitmap(units.hashes[units.at[i] : units.at[i + 1]]) if k not in seen and not seen.add(k) else None for i, k in enumerate(units.key.tolist())] if signed else pa.nulls(m, pa.binary())
                yield pa.RecordBatch.from_arrays([*(pa.nulls(m, t) for t in kinds[:3]), pa.array(units.key), pa.array(units.n.astype(np.int32)), bits if isinstance(bits, pa.Array) else pa.array(bits, pa.binary()), *more(b, found)], schema=schema)
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k in range(0, SKETCH, _CHUNK):
            piece = total[k : k + _CHUNK]
            if piece.any():
                kind = np.uint8 if piece.max() < 256 else np.int64
                yield pa.RecordBatch.from_arrays([pa.array([k // _CHUNK], pa.int32()), pa.array([part // 1024], pa.int32()), pa.array([piece.astype(kind).tobytes()], pa.binary()), *(pa.nulls(1, t) for t in kinds[3:])], schema=schema)

    sql = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}
    return durable(docs.mapInArrow(lean(count), ", ".join(f"{n} {sql[t]}" for n, t in zip(names, kinds))), "survey")


def sketch(surveyed: DataFrame) -> np.ndarray:
    """Counts of units by shingle slot; partitions' pieces are summed in two steps, and come to the driver in FETCHES jobs."""

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(_CHUNK, np.int64)
        for c in t["counts"].to_pylist():
            total += np.frombuffer(c, np.uint8 if len(c) == _CHUNK else np.int64)
        return pa.table({"piece": t["piece"].slice(0, 1), "part": t["part"].slice(0, 1), "counts": [total.tobytes()]})

    kinds = "piece int, part int, counts binary"
    parts = surveyed.where("piece is not null").select("piece", "part", "counts").groupBy("piece", "part").applyInArrow(add, kinds)
    out = np.zeros(SKETCH, np.int64)
    for r in parts.groupBy("piece").applyInArrow(lambda t: add(t), kinds).coalesce(FETCHES).toLocalIterator():
        out[r["piece"] * _CHUNK : (r["piece"] + 1) * _CHUNK] = np.frombuffer(r["counts"], np.int64)
    return np.minimum(out, (1 << 20) - 1).astype(np.int32)


_BLOBS = pa.schema([("bucket", pa.int32()), ("h", pa.binary()), ("c", pa.binary()), ("n", pa.binary())])


def tiles(docs: DataFrame, read: Reader, counts: np.ndarray, percent: int) -> DataFrame:
    """(t, c, n): members of the tiles that have more than one."""
    spark = docs.sparkSession
    shared, buckets = spark.sparkContext.broadcast(counts), width(spark)

    def send(batches):
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []

        def out():
            h, c, n = (np.concatenate(x) for x in zip(*held))
            held.clear()
            to = (h % _U(buckets)).astype(np.int64)
            order = np.sort(to << 32 | np.arange(len(to))) & (1 << 32) - 1
            cuts = np.searchsorted(to[order], np.arange(buckets + 1))
            rows = [(b, order[cuts[b] : cuts[b + 1]]) for b in range(buckets) if cuts[b] < cuts[b + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), *(pa.array([x[o].tobytes() for _, o in rows], pa.binary()) for x in (h, c, n))], schema=_BLOBS)

        size = 0
        for b in batches:
            for units, _ in read(b):
                new = np.array([k not in seen and not seen.add(k) for k in units.key.tolist()], bool)
                if not new.any():
                    continue
                at = units.prefix(shared.value, percent)
                at = at[new[units.unit[at]]]
                held.append((units.hashes[at], units.key[units.unit[at]], units.n[units.unit[at]].astype(np.int32)))
                size += len(at)
                if size > 1 << 20:
                    yield from out()
                    size = 0
        if held:
            yield from out()

    def gather(t: pa.Table) -> pa.Table:
        h, c, n = (np.concatenate([np.frombuffer(x, kind) for x in t[name].to_pylist()]) for name, kind in (("h", _U), ("c", np.int64), ("n", np.int32)))
        # most shingles stand once: only the others are put in order of classes
        order = np.argsort(h)
        equal = np.diff(h[order]) == 0
        order = order[np.append(equal, False) | np.append(False, equal)] if len(h) else order
        order = order[np.lexsort((c[order], h[order]))]
        h, c, n = h[order], c[order], n[order]
        if not len(h):
            return pa.table({"t": c, "c": c, "n": n})
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        h, c, n = h[fresh], c[fresh], n[fresh]
        head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(head, len(h)))
        total = np.add.reduceat(mix(c.view(_U) + _U(3)), head)
        t_id = mix(total + size.astype(_U))
        _, first = np.unique(t_id, return_index=True)
        pick = np.zeros(len(head), bool)
        pick[first] = True
        pick &= size > 1
        on = np.repeat(pick, size)
        return pa.table({"t": np.repeat(t_id, size)[on].view(np.int64), "c": c[on], "n": n[on]})

    blobs = docs.mapInArrow(lean(send), "bucket int, h binary, c binary, n binary")
    return durable(blobs.groupBy("bucket").applyInArrow(lean_group(gather), "t long, c long, n int").dropDuplicates(["t", "c"]), "tiles")


def arrays(docs: DataFrame, read: Reader, classes: DataFrame, signed: bool = False) -> DataFrame:
    """(c, items): sorted arrays of the classes named (and a few more), from another pass over the texts; signed, also n and bits."""
    spark = docs.sparkSession
    active_bits = 1 << min(max(ACTIVE[0], (16 * classes.count()).bit_length()), ACTIVE[1])
    slot = F.pmod("c", F.lit(active_bits)) + 1  # Spark numbers the places of its bitmaps from 1
    rows = classes.groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    active = np.zeros(active_bits // 8, np.uint8)
    for r in rows.coalesce(FETCHES).toLocalIterator():  # at most active_bits in all
        got = np.frombuffer(r["bits"], np.uint8)
        active[(r["k"] - 1) * 4096 : (r["k"] - 1) * 4096 + len(got)] = got
    shared = spark.sparkContext.broadcast(active)

    def emit(batches):
        seen: set[int] = set()
        for b in batches:
            for units, _ in read(b):
                at = units.key % active_bits
                on = np.flatnonzero(shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                on = [i for i in on.tolist() if (k := int(units.key[i])) not in seen and not seen.add(k)]
                if on:
                    items = [units.hashes[units.at[i] : units.at[i + 1]] for i in on]
                    more = {"n": units.n[on].astype(np.int32), "bits": [bitmap(x) for x in items]} if signed else {}
                    yield pa.RecordBatch.from_pydict({"c": units.key[on], "items": [x.tobytes() for x in items], **more})

    made = docs.mapInArrow(lean(emit), "c long, items binary" + (", n int, bits binary" if signed else ""))
    # a class is made once in each partition that has it
    kept = [F.any_value(x).alias(x) for x in (("items", "n", "bits") if signed else ("items",))]
    return durable(made.groupBy("c").agg(*kept), "arrays")


def band(n: int) -> int:
    """The size band of sets of n: they hold at most 2**band."""
    return (n - 1).bit_length()


def bitmap(items: np.ndarray) -> bytes:
    """Hashed bits of a set: 4 * 2**band of them, eight at least."""
    size = max(8, 4 << band(len(items)))
    out = np.zeros(size, np.uint8)
    out[(items % _U(size)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (rows) at a smaller size in bytes: bits are hash modulo size, so halves overlay."""
    while bits.shape[1] > size:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def bound(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """At most so many items in common: each bit that only one side has stands for an item at least that the other lacks."""
    return np.minimum(na - np.bitwise_count(a & ~b).sum(1, dtype=np.int64), nb - np.bitwise_count(b & ~a).sum(1, dtype=np.int64))


def enough(common: np.ndarray, na, nb, percent: int) -> np.ndarray:
    return 100 * common >= percent * (na + nb - common)


def _may(t: pa.RecordBatch, percent: int) -> np.ndarray:
    """Pairs of a batch whose bitmaps allow the threshold."""
    na, nb = t.column("na").to_numpy().astype(np.int64), t.column("nb").to_numpy().astype(np.int64)
    one, two = t.column("bits_a"), t.column("bits_b")
    keep = np.zeros(len(na), bool)
    la = np.array(pa.compute.binary_length(one), np.int64) if len(na) else na
    lb = np.array(pa.compute.binary_length(two), np.int64) if len(na) else nb
    for x, y in set(zip(la.tolist(), lb.tolist())):
        rows = np.flatnonzero((la == x) & (lb == y))
        step = max(1, (1 << 24) // max(x, y))
        for k in range(0, len(rows), step):
            r = rows[k : k + step]
            a = np.frombuffer(b"".join(one.take(pa.array(r)).to_pylist()), np.uint8).reshape(len(r), x)
            b = np.frombuffer(b"".join(two.take(pa.array(r)).to_pylist()), np.uint8).reshape(len(r), y)
            small = min(x, y)
            keep[r] = enough(bound(fold(a, small), na[r], fold(b, small), nb[r]), na[r], nb[r], percent)
    return keep


class Sets:
    """Bitmaps of all classes in tiles, and the sorted arrays of those that a bitmap couldn't part."""

    def __init__(self, docs: DataFrame, read: Reader, signs: DataFrame, percent: int, held: DataFrame | None = None):
        self.docs, self.read, self.signs, self.percent = docs, read, signs, percent
        self.tables, self.whole = [] if held is None else [held], held is not None

    def may(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose bitmaps allow the threshold."""
        percent = self.percent
        signed = pairs.join(self.signs.toDF("a", "na", "bits_a"), "a").join(self.signs.toDF("b", "nb", "bits_b"), "b")

        def run(batches):
            import pyarrow.compute  # noqa: F401

            for t in batches:
                keep = pa.array(_may(t, percent))
                yield pa.RecordBatch.from_arrays([t.column("a").filter(keep), t.column("b").filter(keep)], ["a", "b"])

        return durable(signed.mapInArrow(lean(run), "a long, b long"), "candidates")

    def fetch(self, pairs: DataFrame) -> None:
        """Make the arrays of the classes in pairs that have none yet; nothing is to do where all were made at the start."""
        if self.whole:
            return
        need = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
        for t in self.tables:
            need = need.join(t.select("c"), "c", "left_anti")
        need = durable(need, "need")
        if not need.isEmpty():
            self.tables.append(arrays(self.docs, self.read, need))
            settle(self.docs.sparkSession)
        forget(need)

    def exact(self, pairs: DataFrame) -> DataFrame:
        """The pairs that reach the threshold, by intersection of sorted arrays; fetch() comes first."""
        percent = self.percent
        if not self.tables:
            return pairs
        held = self.tables[0]
        for t in self.tables[1:]:
            held = held.unionByName(t)
        if len(self.tables) > 1:
            held = held.dropDuplicates(["c"])
        # an a with many partners is dealt over several groups, each with its own copy of a's array
        parts = durable(pairs.groupBy("a").agg(F.ceil(F.count("*") / 256).cast("int").alias("parts")), "parts")
        dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts").cast("int"))
        left = dealt.select("a", "part").distinct().join(held.withColumnRenamed("c", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "items")
        right = dealt.select("a", "part", "b").join(held.withColumnRenamed("c", "b"), "b").select("a", "part", "b", "items")

        def intersect(batches):
            now, own = None, np.zeros(0, _U)
            for t in batches:
                a, b = t.column("a").to_pylist(), t.column("b").to_pylist()
                found: list[tuple[int, int]] = []
                for i, item in enumerate(t.column("items")):
                    other = np.frombuffer(item.as_buffer(), _U)
                    if b[i] is None:
                        now, own = a[i], other.copy()
                    elif now == a[i]:
                        at = np.searchsorted(own, other)
                        common = int((own[np.minimum(at, len(own) - 1)] == other).sum())
                        if enough(common, len(own), len(other), percent):
                            found.append((a[i], b[i]))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

        # dealt without a number of its own, so that few pairs come together in few tasks
        lined = left.unionByName(right).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
        out = durable(lined.mapInArrow(lean(intersect), "a long, b long"), "links")
        forget(parts)
        settle(pairs.sparkSession)
        return out


def stars(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): the first member of each tile with every other that sizes allow."""
    pivots = durable(members.groupBy("t").agg(F.min(F.struct("first", "c", "n")).alias("p")).select("t", F.col("p.c").alias("a"), F.col("p.n").alias("na")), "pivots")
    pairs = members.join(pivots, "t").where("c <> a").where(100 * F.least("n", "na") >= percent * F.greatest("n", "na"))
    return pairs.select("a", F.col("c").alias("b")).distinct()


def rest(members: DataFrame, signs: DataFrame, percent: int, group: str | None = None, best: bool = False) -> DataFrame:
    """(a, b): pairs inside tiles whose bitmaps allow the threshold, tile by size band, in blocks.

    With group, members(t, c, n, group) of different groups. Else members(t, c, n, first, open), first being the place (id, h,
    line) of each: an open member with each of an earlier place; with best, where a group has more than PARTNERS of them,
    only with the one whose bitmap promises most, which mostly settles it, and a pair of the member with itself tells that
    others are left.
    """
    marks = [F.col(group).alias("g0")] if group else [F.col(f"first.{x}").cast("long").alias(f"g{i}") for i, x in enumerate(("id", "h", "line"))]
    asks = F.lit(True) if group else F.col("open")
    home = members.select("t", "c", "n", *marks, asks.alias("open")).withColumn("band", F.length(F.bin(F.col("n") - 1)) - F.when(F.col("n") == 1, 1).otherwise(0))
    # a pair's sizes differ by a third at most, so a band meets itself and the next: the smaller side comes as a guest
    spread = home.withColumn("tier", F.explode(F.array("band", F.col("band") + 1)))
    spread = spread.withColumn("guest", F.col("tier") > F.col("band")).where(~F.col("guest") | (F.col("n") * 100 >= percent * F.expr("shiftleft(1, greatest(tier - 1, 0))")))
    # a tier of one group, or in which nobody asks, has no pair
    meets = (F.min("g0") != F.max("g0")) if group else F.max("open")
    sizes = durable(spread.groupBy("t", "tier").agg(F.count("*").alias("m"), F.max(~F.col("guest")).alias("own"), meets.alias("meets")), "tiersizes")
    sizes = sizes.where("own and meets and m > 1").select("t", "tier", F.ceil(F.col("m") / TILE).cast("int").alias("blocks"))
    dealt = spread.join(sizes, ["t", "tier"]).withColumn("block", F.pmod(F.xxhash64("c"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # bitmaps are most of a row, so they join where it is dealt, and travel with it once
    dealt = dealt.select("t", "tier", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "c", "n", *[f"g{i}" for i in range(len(marks))], "open", "guest").join(signs.select("c", "bits"), "c")

    places = ("g0",) if group else ("g0", "g1", "g2")

    def pairs(tier: int, lo: int, hi: int, x: dict[str, np.ndarray], bits: list) -> np.ndarray:
        """What may be linked in one group, as two rows of classes."""
        c, n, g, block, guest, asking = x["c"], x["n"], x["g0"], x["block"], x["guest"], x["open"]
        if not group:  # places as numbers in their order; a class that stands here twice has one
            order = np.lexsort((x["g2"], x["g1"], g))
            ranked = np.stack([x[p][order] for p in places])
            g = np.empty(len(c), np.int64)
            g[order] = np.cumsum(np.concatenate([[0], (ranked[:, 1:] != ranked[:, :-1]).any(0)]))
        size = max(8, 4 << max(tier - 1, 0)) // 8
        bits = np.concatenate([fold(np.frombuffer(y, np.uint8)[None], size) for y in bits])
        bits = bits.view(np.uint64) if size % 8 == 0 else bits
        found: list[np.ndarray] = []
        for one, two in [(lo, hi)] + ([(hi, lo)] if lo != hi and not group else []):
            others = np.flatnonzero(block == two)
            for i in np.flatnonzero((block == one) & asking):
                fits = ~(guest[i] & guest[others]) & (100 * np.minimum(n[i], n[others]) >= percent * np.maximum(n[i], n[others]))
                fits &= ((g[i] != g[others]) & ((c[i] < c[others]) if lo == hi else True)) if group else g[others] < g[i]
                j = others[fits]
                if not len(j):
                    continue
                most = bound(bits[i][None], n[i], bits[j], n[j])
                may = enough(most, n[i], n[j], percent)
                if may.any():
                    j, most = j[may], most[may]
                    if best and len(j) > PARTNERS:
                        j = j[[np.argmax(most / (n[i] + n[j] - most))]]
                        found.append(np.full((2, 1), c[i]))
                    found.append(np.stack([np.minimum(c[i], c[j]), np.maximum(c[i], c[j])]))
        return np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)

    keys, numbers = ("t", "tier", "lo", "hi"), ("c", "n", "block", "guest", "open", *places)

    def run(batches):
        """Groups one after another: there are many small ones, so they come in batches, and the last one waits for the next."""
        rest_: list[pa.RecordBatch] = []
        for b in _and_end(batches):
            if b is not None and not b.num_rows:
                continue
            held = rest_ + ([b] if b is not None else [])
            if not held:
                break
            at = np.stack([np.concatenate([y.column(k).to_numpy() for y in held]) for k in keys])
            cuts = np.flatnonzero(np.concatenate([[True], (at[:, 1:] != at[:, :-1]).any(0), [True]]))
            if b is not None and len(cuts) == 2:  # one group so far
                rest_ = held
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            x = {k: t[k].to_numpy(zero_copy_only=False) for k in numbers}
            x["n"] = x["n"].astype(np.int64)
            bits = t["bits"].to_pylist()
            out = [pairs(*(int(v) for v in at[1:, i]), {k: v[i:j] for k, v in x.items()}, bits[i:j]) for i, j in zip(cuts[:-1], cuts[1:] if b is None else cuts[1:-1]) if j - i > 1]
            rest_ = [] if b is None else t.slice(cuts[-2]).to_batches()
            both = np.concatenate(out, 1) if out else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[0], pa.int64()), pa.array(both[1], pa.int64())], ["a", "b"])

    lined = dealt.repartition(*keys).sortWithinPartitions(*keys)
    return durable(lined.mapInArrow(lean(run), "a long, b long").distinct(), "rest")


def _and_end(batches):
    """The batches, then None."""
    yield from batches
    yield None


def link(docs: DataFrame, read: Reader, surveyed: DataFrame, order: DataFrame, percent: int, small: bool = False, last: bool = False) -> tuple[DataFrame, Sets]:
    """Tiles' members (t, c, n, first), with the order of classes given as order(c, first), and their sets.

    Small sets (lines) are made with their bitmaps for all members in one pass over the texts; of others the survey has the
    bitmaps, and arrays are made for what these can't part. last: the survey is read by nobody else, so it goes.
    """
    found = tiles(docs, read, sketch(surveyed), percent)
    members = durable(found.join(order.select("c", "first"), "c"), "members")
    forget(found)
    settle(docs.sparkSession)
    each = members.select("c").distinct()
    if small:
        held = arrays(docs, read, each, signed=True)
        settle(docs.sparkSession)
        return members, Sets(docs, read, held.select("c", "n", "bits"), percent, held.select("c", "items"))
    signs = surveyed.where("bits is not null").select("c", "n", "bits").join(each, "c", "left_semi")
    signs = durable(signs.groupBy("c").agg(F.any_value("n").alias("n"), F.any_value("bits").alias("bits")), "signs")
    if last:
        forget(surveyed)
    return members, Sets(docs, read, signs, percent)


def crowded(members: DataFrame) -> DataFrame:
    """Members of the tiles of three and more: two meet as a star."""
    many = durable(members.groupBy("t").agg(F.count("*").alias("m")).where("m > 2").select("t"), "crowded")
    return members.join(many, "t")


#: Tiles that overlap are compared as one family of classes, up to so many; members of a larger one meet in its tiles.
FAMILY = 20_000


def families(members: DataFrame) -> DataFrame:
    """members with t replaced by the family of its tile, each class once: overlapping tiles would compare a pair many times.

    A family holds its tiles' members, so no pair is lost; where it outgrows FAMILY, its tiles stay as they are.
    """
    heads = members.groupBy("t").agg(F.min("c").alias("head"))
    named = durable(components(members.join(heads, "t").select(F.col("c").alias("u"), F.col("head").alias("v"))), "families").toDF("c", "f")
    sizes = named.groupBy("f").agg(F.count("*").alias("size"))
    placed = members.join(named.join(durable(sizes, "sizes"), "f"), "c")
    return placed.withColumn("t", F.when(F.col("size") <= FAMILY, F.col("f")).otherwise(F.col("t"))).drop("f", "size").dropDuplicates(["t", "c"])


def linked_components(members: DataFrame, sets_: Sets, percent: int) -> DataFrame:
    """(c, component): classes that have a link to another; component is the least class key reachable."""
    pairs = sets_.may(stars(members, percent))
    sets_.fetch(pairs)
    links = sets_.exact(pairs)
    named = durable(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "components")
    # tiles of more than one component: everyone meets everyone of another component
    grouped = crowded(members).join(named.select(F.col("node").alias("c"), "component"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    grouped = durable(grouped.select("t", "c", "n", "component"), "grouped")
    open_ = durable(grouped.groupBy("t").agg((F.min("component") != F.max("component")).alias("open")).where("open").select("t"), "open")
    more = rest(families(durable(grouped.join(open_, "t"), "opened")), sets_.signs, percent, "component")
    sets_.fetch(more)
    edges = sets_.exact(more).select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(named.select(F.col("node").alias("u"), F.col("component").alias("v")))
    return components(edges).select(F.col("node").alias("c"), "component")

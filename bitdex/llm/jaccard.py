"""Exact Jaccard join of shingle sets in metric space (distance 1 - Jaccard, which obeys
the triangle inequality), with pivots, Voronoi cells and windows.

Unrelated texts lie at distance 1 from every pivot, where the triangle inequality
separates nothing, so the join first cuts the corpus into regions that hold
all links, and pivots divide the regions that are large:

1. Equal sets become one class. Two sets of sizes a and b link only if they share
   ``need(a) = ceil(0.75 a)`` shingles, so a set may miss at most a - need(a).
2. *Shared shingles.* The first ``SCAN`` of each set in hash order are counted over
   the whole corpus. A set that shares too few of them with any other set has no
   link: fewer than ``least_credit``, whatever size the other has and wherever in hash order
   the shingles lie that only one of the two has. Common passages alone don't carry a set over that line.
3. *Regions.* What is left is counted again, whole. Two linked sets share one of the
   a - need(a) + 1 hashes of each that fewest sets have (prefix principle, rarest first).
   Connected sets of that relation form a region.
   Regions of up to ``REGION`` sets are joined whole, by one matrix product.
4. *Pivots.* In a larger region each set gets its distances to ~``PIVOTS`` pivots
   (seeded by hash), goes to the Voronoi cell of the nearest, and links to those
   within the radius 0.25. What is connected through pivots needs no more looks at its
   pairs: only sets outside the region's largest component (*outer* sets) are still
   compared. While they are many and pivots take them away, more are drawn among them.
5. *Windows.* An outer set is copied to the blocks of a cell whose distances to the
   cell's pivot lie within 0.25 of its own: elsewhere the triangle inequality rules out
   a link. Of these, only blocks that hold a set with one of its rare hashes (step 3) get a copy.
   There it is compared exactly.
6. Links become components by contraction.

Sets travel once for each of these steps, and the shuffle files and tables of a step go when it ends.
No step sends a region to one task: cells are cut into blocks of ``BLOCK`` sets, and
what is compared with them is copied to the blocks. Nothing is capped or
sampled: pivots only decide which comparisons are needless.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_cut
from .common import BROADCAST_KEYS, by_key, free_shuffles, map_batches, row_key, shuffle_partitions, table
from .components import components
from .words import Powers, prefix_sums, span_hashes, window_hashes, word_hashes

SHINGLE = 5
PERCENT = 75            # link if 100 * common >= PERCENT * union
SCAN = 0.4              # share of a set's hashes that the corpus-wide count sees
REGION = 256            # sets of a region that is joined whole
BLOCK = 128             # sets of a block of a larger region
PIVOTS = 32
OUTER = 4096            # outer sets of a region from which more pivots are tried
RADIUS = 1 - PERCENT / 100


def need(n):
    """Shingles that a set of n must share with any set it links to."""
    return -(-PERCENT * n // 100)


def shingle_sets(column: pa.Array, powers: Powers, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; of all its words, if fewer."""
    for _, w, offsets in word_hashes(column, lower=True):
        p = prefix_sums(w, powers)
        shingles = window_hashes(p, k, powers)
        for a, b in zip(offsets[:-1], offsets[1:]):
            if b - a >= k:
                yield np.unique(shingles[a:b - k + 1])
            elif b > a:
                yield span_hashes(p, np.array([a]), np.array([b]), powers) ^ np.uint64(b - a)
            else:
                yield np.zeros(0, np.uint64)


def set_id(u: np.ndarray) -> int:
    """Key of a set, as a signed 64-bit number; 0 is kept for 'several'."""
    key = xxhash.xxh64_intdigest(u.tobytes()) or 1
    return key - (1 << 64) if key >> 63 else key


def _describe(k: int):
    """Row key -> set id and size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            sets = [(set_id(u), len(u)) for u in shingle_sets(batch.column(1), powers, k)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(2, batch.num_columns)]
                + [batch.column(0), pa.array([s for s, _ in sets], pa.int64()),
                   pa.array([n for _, n in sets], pa.int32())],
                names=batch.schema.names[2:] + ["rk", "sid", "n"])
    return run


SLICE = 1_000_000       # hashes of the sets that are dealt out together
HIGH = np.uint64(32)    # bits of a hash that don't travel


def _short(h: np.ndarray, parts: int) -> np.ndarray:
    """Hashes by the bits that count: those that name the part, and the upper half, which is all that travels.
    Two hashes may agree in these: then both count as shared, and exact comparisons follow."""
    return h >> HIGH << HIGH | h & np.uint64(parts - 1)


def _sent(h: np.ndarray) -> bytes:
    return (h >> HIGH).astype(np.uint32).tobytes()


def _slices(batches: Iterator[pa.RecordBatch], powers: Powers, k: int) -> Iterator[dict[int, np.ndarray]]:
    """The different sets of some texts, as many as a slice holds."""
    sets, size = {}, 0
    for batch in batches:
        for u in shingle_sets(batch.column(1), powers, k):
            if len(u):
                key = set_id(u)
                size += 0 if key in sets else len(u)
                sets.setdefault(key, u)
                if size >= SLICE:
                    yield sets
                    sets, size = {}, 0
    if sets:
        yield sets


def _scatter(k: int, parts: int, share: float):
    """The first hashes of each set, dealt out to ``parts`` by value: rows
    (part, hashes, set ids, hashes of each). A hash that several sets of the batch
    have is sent once, under set id 0, and credited to its sets here (part -1).
    Hashes of one set that agree in what is sent are credited here as well, so what is sent of a set differs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for sets in _slices(batches, powers, k):
            ids = np.fromiter(sets, np.int64, len(sets))
            sizes = np.array([len(u) for u in sets.values()])
            seen = scanned(sizes, share)
            h = _short(np.concatenate([u[:n] for u, n in zip(sets.values(), seen)]), parts)
            own = np.repeat(np.arange(len(ids)), seen)
            order = np.argsort(h, kind="stable")
            h, own = h[order], own[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            count = np.diff(np.append(first, len(h)))
            many = np.repeat(count > 1, count)
            credit = np.bincount(own[many], minlength=len(ids))
            has = credit > 0
            out = [(-1, b"", ids[has].tobytes(), credit[has].astype(np.int32).tobytes())]
            one = ~many
            h = np.concatenate([h[first[count > 1]], h[one]])
            own = np.concatenate([np.full(int((count > 1).sum()), -1), own[one]])
            part = (h & np.uint64(parts - 1)).astype(np.int64)
            order = np.lexsort((own, part))
            h, own, part = h[order], own[order], part[order]
            cuts = np.searchsorted(part, np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cuts)):
                a, b = cuts[p], cuts[p + 1]
                whose, n = np.unique(own[a:b], return_counts=True)
                sid = np.where(whose < 0, 0, ids[whose])
                out.append((int(p), _sent(h[a:b]), sid.tobytes(), n.astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                names=["part", "hashes", "sids", "ns"])
    return run


def scanned(n, share: float):
    """How many of a set's n hashes the corpus-wide count sees."""
    return np.minimum(n, np.maximum(n - need(n) + 1, np.ceil(share * n).astype(np.int64)))


def least_credit(n: int, share: float) -> int:
    """The fewest common hashes that both scans see of a set of n and any set it links to: where
    both sets' own hashes come first. At least 1."""
    b = np.arange(need(n), 100 * n // PERCENT + 1)
    common = -(-PERCENT * (n + b) // (100 + PERCENT))
    return int((np.minimum(scanned(np.int64(n), share) - n, scanned(b, share) - b) + common).min())


def _least_credits(share: float):
    """(n, enough) of each size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [least_credit(n, share) for n in batch.column("n").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("n"), pa.array(least, pa.int64())], names=["n", "enough"])
    return run


def _credit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set id -> how many of its hashes another set has too, of the parts in this task."""
    parts: dict[int, list] = {}
    for batch in batches:
        ready = []
        for part, h, s, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
            s, n = np.frombuffer(s, np.int64), np.frombuffer(n, np.int32)
            if part < 0:
                ready.append((s, n.astype(np.int64)))
            else:
                parts.setdefault(part, []).append((np.frombuffer(h, np.uint32), np.repeat(s, n)))
        if ready:
            yield _counts(ready)
    for part in list(parts):
        h, s = (np.concatenate(x) for x in zip(*parts.pop(part)))
        order = np.lexsort((s, h))
        h, s = h[order], s[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (s[1:] != s[:-1])])
        h, s = h[new], s[new]                                   # a set counts once
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        count = np.diff(np.append(first, len(h)))
        got = s[np.repeat(count > 1, count) & (s != 0)]
        if len(got):
            yield _counts([np.unique(got, return_counts=True)])


def _counts(pairs) -> pa.RecordBatch:
    s, n = (np.concatenate(x) for x in zip(*pairs))
    return pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(n, pa.int64())],
                                      names=["sid", "credit"])


PACK = 512          # sets in a pack


def _packs(k: int):
    """Chosen texts as packs of sets: (pack, sids, ns, u), the sets one after another; a task packs a set once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, made, ready, known = Powers(), 0, [], set()
        task = TaskContext.get().partitionId()

        def pack() -> pa.RecordBatch:
            ids = np.array([set_id(u) for u in ready], np.int64)
            row = ((task << 32) + made, ids.tobytes(), np.array([len(u) for u in ready], np.int32).tobytes(),
                   b"".join(u.tobytes() for u in ready))
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["pack", "sids", "ns", "u"])

        for batch in batches:
            for u in shingle_sets(batch.column(1), powers, k):
                if (key := set_id(u)) in known:
                    continue
                known.add(key)
                ready.append(u)
                if len(ready) == PACK:
                    yield pack()
                    made, ready = made + 1, []
        if ready:
            yield pack()
    return run


def _open(batch: pa.RecordBatch):
    """(pack, sids, ns, hashes) of each pack."""
    for pack, sids, ns, u in zip(*(batch.column(c).to_pylist() for c in ("pack", "sids", "ns", "u"))):
        yield pack, np.frombuffer(sids, np.int64), np.frombuffer(ns, np.int32), np.frombuffer(u, np.uint64)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, sids, ns, u in _open(batch):
            sets = [x.tobytes() for x in np.split(u, np.cumsum(ns)[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(sids), pa.array(sets, pa.binary())], names=["sid", "u"])


def _dealt(u: np.ndarray, parts: int):
    """(distinct hashes ordered by part, how often each occurs, where each part begins)."""
    h, n = np.unique(u, return_counts=True)
    part = (h & np.uint64(parts - 1)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return h[order], n[order], np.searchsorted(part[order], np.arange(parts + 1))


def _ask(parts: int):
    """(part, pack, hashes, counts): each pack's distinct hashes (their upper halves), with how often it has them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, _, _, u in _open(batch):
                h, n, cuts = _dealt(u, parts)
                rows = [(p, pack, _sent(h[cuts[p]:cuts[p + 1]]), n[cuts[p]:cuts[p + 1]].astype(np.int32).tobytes())
                        for p in np.flatnonzero(np.diff(cuts)).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
                    zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["part", "pack", "h", "n"])
    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pack, part, counts): how many sets of the corpus have each hash a pack asked about. Hashes that agree in
    what was sent count together, the same for every set that has one of them, so one order of all hashes is left."""
    asked: dict[int, list] = {}
    for batch in batches:
        for part, pack, h, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
            asked.setdefault(part, []).append((pack, np.frombuffer(h, np.uint32), np.frombuffer(n, np.int32)))
    for part in list(asked):
        packs, hs, ns = zip(*asked.pop(part))
        _, where = np.unique(np.concatenate(hs), return_inverse=True)
        total = np.bincount(where, np.concatenate(ns))[where].astype(np.int32)
        counts = [x.tobytes() for x in np.split(total, np.cumsum([len(h) for h in hs])[:-1])]
        yield pa.RecordBatch.from_arrays([pa.array(packs, pa.int64()), pa.array([part] * len(packs), pa.int32()),
                                          pa.array(counts, pa.binary())], names=["pack", "part", "counts"])


def _prefixes(parts: int):
    """(sid, h): of each set, of the a - need(a) + 1 hashes that fewest sets have, those that another
    set has too. A linked pair shares one of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = batch.column("answers").to_pylist()
            for (_, sids, ns, u), got in zip(_open(batch), answers):
                h, _, _ = _dealt(u, parts)
                total = np.concatenate([np.frombuffer(x["counts"], np.int32)
                                        for x in sorted(got, key=lambda x: x["part"])])
                order = np.argsort(h)
                often = total[order][np.searchsorted(h, u, sorter=order)]
                out = []
                for sid, a, b in zip(sids, np.cumsum(ns) - ns, np.cumsum(ns)):
                    x, c = u[a:b], often[a:b]
                    first = np.lexsort((x, c))[:len(x) - need(len(x)) + 1]
                    first = first[c[first] > 1]
                    out.append((np.full(len(first), sid), x[first].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["sid", "h"])
    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Common elements of every two sets, by matrix products over slices of the elements."""
    n, m = len(left), len(left) if right is None else len(right)
    every = left if right is None else left + right
    values = np.concatenate(every)
    own = np.repeat(np.arange(len(every)), [len(u) for u in every])
    order = np.argsort(values, kind="stable")
    values, own = values[order], own[order]
    new = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column, minlength=1)[column] > 1 if len(values) else new
    values, own, column = values[shared], own[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    out = np.zeros((n, m), np.float64)
    width = max(1, 4_000_000 // max(1, len(every)))
    for a in range(0, int(column.max()) + 1 if len(column) else 0, width):
        here = (column >= a) & (column < a + width)
        hot = np.zeros((len(every), min(width, int(column.max()) + 1 - a)), np.float32)
        hot[own[here], column[here] - a] = 1
        out += hot[:n] @ (hot[:n] if right is None else hot[n:]).T
    return out


def jaccards(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, linked) for sizes a (rows) and b (columns)."""
    union = a[:, None] + b[None, :] - common
    return common / np.maximum(union, 1), 100 * common >= PERCENT * union


def _whole_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of whole regions, each an array of sets; a set may come from several tasks."""
    for batch in batches:
        a, b = [], []
        for members in batch.column("members").to_pylist():
            members = list({x["sid"]: x for x in members}.values())
            sets = [np.frombuffer(x["u"], np.uint64) for x in members]
            sid = np.array([x["sid"] for x in members])
            n = np.array([len(u) for u in sets])
            _, linked = jaccards(overlaps(sets), n, n)
            i, j = np.nonzero(np.triu(linked, 1))
            a.append(np.minimum(sid[i], sid[j]))        # whatever order the members come in
            b.append(np.maximum(sid[i], sid[j]))
        if a:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x), pa.int64()) for x in (a, b)], names=["a", "b"])


def _against_probes(all_pairs: bool):
    """(region, sid, probe, distance, linked) for each set of a block and each probe
    sent there, or only for those that link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _block_pairs(batch, all_pairs)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out],
                                                 names=["region", "sid", "probe", "d", "linked"])
    return run


def _block_pairs(batch: pa.RecordBatch, all_pairs: bool) -> list[list[np.ndarray]]:
    out = [[], [], [], [], []]
    for region, members, probes in zip(*(batch.column(c).to_pylist()
                                         for c in ("region", "members", "probes"))):
        left, right = ([np.frombuffer(x["u"], np.uint64) for x in y] for y in (members, probes))
        a, b = (np.array([len(u) for u in y]) for y in (left, right))
        like, linked = jaccards(overlaps(left, right), a, b)
        i, j = np.nonzero(linked | all_pairs)
        out[0].append(np.full(len(i), region))
        out[1].append(np.array([x["sid"] for x in members])[i])
        out[2].append(np.array([x["sid"] for x in probes])[j])
        out[3].append(1 - like[i, j])
        out[4].append(linked[i, j])
    return out


def _compare(blocks: DataFrame, probes: DataFrame, all_pairs: bool = False) -> DataFrame:
    """Every set of ``blocks`` (region, block, sid, u) against the ``probes`` sent to its block
    (region, block, sid, u)."""
    def packed(df, name):
        return df.groupBy("region", "block").agg(F.collect_list(F.struct("sid", "u")).alias(name))
    return (packed(blocks, "members").join(packed(probes, "probes"), ["region", "block"])
            .select("region", "members", "probes")
            .transform(map_batches, _against_probes(all_pairs), "region long, sid long, probe long, d double, linked boolean"))


def _draw(rows: DataFrame, counts: DataFrame, wanted: int, seed: int) -> DataFrame:
    """About ``wanted`` rows of each region by a seeded hash; ``counts``: (region, n_rows)."""
    place = F.xxhash64(F.lit(seed), "sid").bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    return (rows.join(counts, "region")
            .filter(place * F.col("n_rows") < F.lit(float(wanted))).drop("n_rows"))


def _placed(sets: DataFrame, marks: DataFrame) -> DataFrame:
    """The ``sets`` (sid, u) that have ``marks`` (sid, region, a written table), with their region. The marks are
    counted before they are broadcast; more than that meet the sets by a shuffle."""
    marks = marks.select("sid", "region")
    return sets.join(F.broadcast(marks) if marks.count() <= BROADCAST_KEYS else marks, "sid")


def _copies(outer: DataFrame, cells: DataFrame, far: DataFrame, heads: DataFrame) -> DataFrame:
    """(region, block, sid): the blocks of ``cells`` (region, cell, block, dist, sid) that each ``outer`` set
    (region, sid) is copied to. A linked pair shares one of the ``heads`` (sid, h) of both, so the block holds
    a set with such a hash, and its distances to the cell's pivot allow a link to one ``far`` (region, sid,
    cell, d) away."""
    held = cells.select("region", "block", "sid").join(heads, "sid").select("region", "block", "h").distinct()
    met = (outer.select("region", "sid").join(heads, "sid").join(held, ["region", "h"])
           .select("region", "block", "sid").distinct())
    span = cells.groupBy("region", "cell", "block").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"))
    window = ((F.col("d").isNull()) | ((F.col("d") >= F.col("lo") - RADIUS - 1e-9)
                                       & (F.col("d") <= F.col("hi") + RADIUS + 1e-9)))
    return (met.join(span, ["region", "block"]).join(far, ["region", "sid", "cell"], "left").filter(window)
            .select("region", "block", "sid").distinct())


def _large_regions(sets: DataFrame, regions: DataFrame, heads: DataFrame, pivots: int, block: int,
                   many_outer: int) -> DataFrame:
    """Links that connect the sets of large regions, written. ``sets``: (region, sid, u);
    ``regions``: (region, size); ``heads``: (sid, h)."""
    def spread(df):      # block numbers of a region, by hash
        return df.withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))

    sets = cut_lineage(spread(sets.join(regions, "region")).withColumn(
        "block", F.pmod(F.xxhash64(F.lit(1), "sid"), F.col("blocks").cast("long")).cast("int")), "regions")

    def everywhere(probes):
        """A copy of each probe for each block of its region."""
        return probes.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    counts = regions.select("region", F.col("size").alias("n_rows"))
    drawn = cut_lineage(_draw(sets, counts, pivots, 11).select("region", "blocks", "sid", "u"), "pivots")
    seen = cut_lineage(_compare(sets, everywhere(drawn), True), "distances")
    probed = drawn.select("sid")
    nearest = (seen.groupBy("region", "sid")
               .agg(F.min_by(F.struct("probe", "d"), F.struct("d", "probe")).alias("p"))
               .select("region", "sid", F.col("p.probe").alias("cell"), F.col("p.d").alias("dist")))
    links = seen.filter("linked AND sid <> probe").select(F.col("sid").alias("a"), F.col("probe").alias("b"))
    level, before = 0, None
    while True:
        label = components(links) if not links.isEmpty() else None
        where = sets.select("region", "sid", "blocks")
        where = (where.withColumn("label", F.col("sid")) if label is None else
                 where.join(label.withColumnRenamed("node", "sid"), "sid", "left")
                 .withColumn("label", F.coalesce("label", "sid")))
        main = (where.groupBy("region", "label").agg(F.count("*").alias("c"))
                .groupBy("region").agg(F.max_by("label", F.struct("c", "label")).alias("main")))
        outer = cut_lineage(where.join(main, "region").filter("label <> main")
                            .select("region", "sid").join(probed, "sid", "left_anti"), "outer")
        left = cut_lineage(outer.groupBy("region").agg(F.count("*").alias("n_rows")), "left")
        level += 1
        wanted = pivots * 2 ** level
        # go on where many are left and the last pivots took away a fifth of them, beside themselves
        many = left.filter(F.col("n_rows") > max(many_outer, 2 * wanted))
        if before is not None:
            many = many.join(before.withColumnRenamed("n_rows", "was"), "region").filter(
                F.col("n_rows") <= 0.8 * F.col("was") - wanted / 2).select("region", "n_rows")
        before = left
        if many.isEmpty():
            break
        more = _draw(outer, many, wanted, 11 + level)
        more = cut_lineage(sets.select("region", "blocks", "sid", "u").join(more, ["region", "sid"]), "pivots")
        found = _compare(sets, everywhere(more)).filter("linked AND sid <> probe")
        links = cut_lineage(links.unionByName(
            found.select(F.col("sid").alias("a"), F.col("probe").alias("b"))), "links")
        probed = probed.unionByName(more.select("sid"))

    # Cells in blocks; an outer set goes to the blocks its distance to the cell's pivot allows.
    cells = sets.select("region", "sid", "u").join(nearest, ["region", "sid"], "left")
    cells = cells.withColumn("cell", F.coalesce("cell", F.lit(0).cast("long"))).withColumn(
        "dist", F.coalesce("dist", F.lit(0.0)))
    sizes = cells.groupBy("region", "cell").agg(F.ceil(F.count("*") / block).cast("long").alias("nb"))
    cells = cells.join(sizes, ["region", "cell"]).withColumn(
        "block", F.xxhash64("cell", F.pmod(F.xxhash64(F.lit(2), "sid"), F.col("nb"))))
    cells = cut_lineage(cells.select("region", "cell", "block", "dist", "sid", "u"), "cells")
    far = seen.select("region", "sid", F.col("probe").alias("cell"), "d")
    copies = _copies(outer, cells, far, heads).join(sets.select("sid", "u"), "sid")
    found = _compare(cells, copies).filter("linked AND sid <> probe")
    links = cut_lineage(links.unionByName(found.select(F.col("sid").alias("a"), F.col("probe").alias("b"))), "links")
    drop_cut(sets, cells, seen)
    return links


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = SHINGLE,
                    share: float = SCAN, region: int = REGION, block: int = BLOCK,
                    pivots: int = PIVOTS, outer: int = OUTER) -> DataFrame:
    """(doc_id, rk, n_shingles, component_id, n_same) of each row of ``docs``.

    ``component_id`` is the smallest id reachable by links (nulls count as greater
    than every id); ``rk`` keys the row by id and text; ``n_same``: rows of the same
    set. Null and empty texts have no shingles, link with nothing and keep their own
    id. Texts of fewer than k words are one shingle. Repeated rows are equal sets. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(row_key(id, text).alias("rk"), F.col(text).cast("binary").alias("text"),
                       F.col(id).alias("doc_id"))
    kind = dict(rows.dtypes)["doc_id"]
    known = cut_lineage(rows.select("rk", "text", "doc_id").transform(map_batches,
        _describe(k), f"doc_id {kind}, rk long, sid long, n int"), "sets")
    classes = cut_lineage(known.filter("n > 0").groupBy("sid", "n").agg(
        F.min("doc_id").alias("least"), F.min("rk").alias("rk"), F.count("*").alias("same")), "classes")

    total = classes.agg(F.sum(F.ceil(F.col("n") * share))).first()[0] or 0
    tasks = max(shuffle_partitions(spark), total // 4_000_000 + 1)
    parts = 1 << (4 * int(tasks) - 1).bit_length()
    credit = (rows.select("rk", "text").transform(map_batches,
        _scatter(k, parts, share), "part int, hashes binary, sids binary, ns binary")
        .repartition(int(tasks), F.when(F.col("part") < 0, F.rand(7)).otherwise(F.col("part")))
        .transform(map_batches, _credit, "sid long, credit long").groupBy("sid").agg(F.sum("credit").alias("credit")))
    sizes = classes.select("n").distinct().transform(map_batches, _least_credits(share), "n int, enough long")
    chosen = cut_lineage(classes.join(credit, "sid").join(F.broadcast(sizes), "n").filter("credit >= enough")
                         .select("rk"), "chosen")
    free_shuffles(spark)
    packs = cut_lineage(by_key(rows.select("rk", "text"), F.col("rk"), chosen, "left_semi").transform(map_batches,
        _packs(k), "pack long, sids binary, ns binary, u binary"), "packs")
    sets = packs.transform(map_batches, _unpack, "sid long, u binary")
    answers = (packs.transform(map_batches, _ask(parts), "part int, pack long, h binary, n binary")
               .repartition(int(tasks), "part").transform(map_batches, _answer, "pack long, part int, counts binary")
               .groupBy("pack").agg(F.collect_list(F.struct("part", "counts")).alias("answers")))
    heads = cut_lineage(packs.join(answers, "pack").transform(map_batches, _prefixes(parts), "sid long, h long").distinct(),
                        "heads")
    free_shuffles(spark)
    least = cut_lineage(heads.groupBy("h").agg(F.min("sid").alias("a"), F.max("sid").alias("_b"))
                        .filter("a <> _b").select("h", "a"), "least")
    near = heads.join(least, "h").filter("sid <> a").select("a", F.col("sid").alias("b")).distinct()
    region_of = components(near)
    sized = cut_lineage(region_of.groupBy(F.col("label").alias("region")).agg(F.count("*").alias("size")), "regions")
    marks = cut_lineage(region_of.select(F.col("node").alias("sid"), F.col("label").alias("region")).join(sized, "region"),
                        "marks")
    free_shuffles(spark)
    small = _placed(sets, marks.filter(F.col("size") <= region))
    links = (small.groupBy("region").agg(F.collect_list(F.struct("sid", "u")).alias("members"))
             .select("members").transform(map_batches, _whole_regions, "a long, b long"))
    large = sized.filter(F.col("size") > region)
    if not large.isEmpty():
        links = cut_lineage(links, "links")
        free_shuffles(spark)
        links = links.unionByName(_large_regions(
            _placed(sets, marks.filter(F.col("size") > region)).dropDuplicates(["sid"]).select("region", "sid", "u"),
            large, heads, pivots, block, outer))
    label = components(links)
    drop_cut(chosen, packs, heads, least, marks)             # what follows reads the written labels
    free_shuffles(spark)
    classes = classes.join(label.withColumnRenamed("node", "sid"), "sid", "left").withColumn(
        "label", F.coalesce("label", "sid"))
    lowest = classes.groupBy("label").agg(F.min("least").alias("component"))
    classes = classes.join(lowest, "label").select("sid", "component", "same")
    return (known.join(classes, "sid", "left")
            .select("doc_id", "rk", F.col("n").cast("long").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
                    F.coalesce("same", F.lit(1)).cast("long").alias("n_same")))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set and its near-duplicate component."""
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "n_same")

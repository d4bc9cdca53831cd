"""Exact n-gram Jaccard self-join by a size-aware split into light and heavy sets.

Sets are five-word shingles.  Two sets of sizes a <= b reach the threshold 3/4 only if they share at least
c(b) = ceil(3 b / 4) elements.

*Light* sets, of at most ``boundary`` elements, enumerate their subsets of each fixed size c(b) that a light
partner can ask for; two light sets that link list a common subset.  *Heavy* sets scan inverted lists: with all
elements in one global order, two sets that link share an element among each one's first n - c(n) + 1, so only
those are listed, by heavy sets and by light sets large enough to link to one.  The boundary minimises the
number of subsets listed plus the list entries scanned, from the counts of sets by size.

The global order puts elements that many sets hold last: it is the logarithm of a count in a sketch of fixed size
(``2 ** SKETCH`` counters summed over all documents), then the hash.  Any order is correct; this one keeps common
passages out of the lists.

Only components are asked for, so a list is not expanded into its pairs.  Every step is exact:

* Equal sets are one set; copies are collapsed within an Arrow batch, and altogether when lists are sorted.
* Lists are dealt by element, many to a bucket, as packed columns of eight bytes an entry.  An element whose sketch
  count, never too low, exceeds ``HOT`` is dealt over several buckets as well; no task's list grows without bound.
* First, each set of a list is paired with the list's ``LEADERS`` least sets.  Of those that pass the bounds each
  set's nearest by sketch is verified and joined to components.  A list that then lies in one component is done.
* Of the other lists, those with one largest component are one unit.  Its sets outside that component are compared with
  all its sets of other components by parity sketches, in blocks of packed arrays.  Each set's nearest is verified first, and the components joined
  again.  What then still lies apart and is not refuted by its sketch is verified pair by pair.
* Parity sketches of 1024 bits, more for larger sets, give a lower bound of the sets' difference.  Whole sets are compared from the
  compressed texts of the sets in question.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loamwork.llm.common import bounded_batches, documents, id_text, map_rows, shared_checkpoint
from loamwork.llm.components import components
from loamwork.llm.rowfilter import anti_join, filter_of, may_be_in
from loamwork.llm.shingles import mix, set_identities, shingle_set

SKETCH = 22
SKETCH_BLOCKS = 64
PARITY_WORDS = 16
LARGEST_BOUNDARY = 10
#: Sets of a list that each of its sets is paired with at first.
LEADERS = 2
HOT = 200_000
#: Sub-buckets of a hot element.
SALTS = 64
ENTRIES_A_BUCKET = 500_000
LEAST_BUCKETS = 64
#: Sets whose row keys (24 bytes each) are broadcast.
BROADCAST_SETS = 1 << 19
#: Sets of a unit of lists that are compared as one block: those outside its largest component, and all.
BLOCK_OUTSIDE, BLOCK_ALL = 1024, 4096
ROWS_A_BLOCK_BUCKET = 50_000


def needed(n: int) -> int:
    """The least overlap of a set of n elements with any set it links to."""
    return -(-3 * n // 4)


def _parity(s: np.ndarray) -> bytes:
    """The parity of the elements in each of at least four bins an element, ``64 * PARITY_WORDS`` or a power of two times that."""
    bins = 64 * PARITY_WORDS << max(0, math.ceil(math.log2(max(1, len(s)) / (16 * PARITY_WORDS))))
    return np.packbits((np.bincount((s & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1).astype(np.uint8)).tobytes()


def _folded(p: np.ndarray, words: int) -> np.ndarray:
    """Sketches (in the last axis) as they would be with fewer bins: a bin's place is the lowest bits of its elements."""
    while p.shape[-1] > words:
        half = p.shape[-1] // 2
        p = p[..., :half] ^ p[..., half:]
    return p


def _coarse(sigs: list[int], sizes: list[int], parities: list[bytes]) -> dict:
    """Sets with sketches of a quarter of their bins, 1024 at least: what blocks are compared by."""
    return {"sig": sigs, "n": sizes, "parity": [_folded(p := np.frombuffer(q, np.uint64), max(PARITY_WORDS, len(p) // 4)).tobytes() for q in parities]}


#: A null doc_id counts above all.
TOP = (1 << 63) - 1


def _row_key() -> list[Column]:
    """A row's id and its text's hash, by which rows of equal or null ids differ unless their texts are equal."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(TOP)).alias("_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_hash")]


def _identity(s: np.ndarray, collided: frozenset[int]) -> int:
    """The set's identity: 64 bits, or 64 others for the few sets whose first 64 bits another set has too."""
    first, second = set_identities(s)
    return second if first in collided else first


def _summaries(rows: DataFrame) -> DataFrame:
    """For each row doc_id, its text's hash, n, sig, chk (two identities) and parity; for each task the blocks of its sketch (block, counts)."""
    bounded_batches(rows.sparkSession)
    schema = "doc_id long, _hash long, n long, sig long, chk long, parity binary, block int, counts binary"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH, dtype=np.uint32)
        used = False
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
            if not sets:
                continue
            sigs = [set_identities(s) for s in sets]
            fresh = {g: s for g, s in zip(sigs, sets)}  # equal sets of a batch count once
            at, times = np.unique((np.concatenate(list(fresh.values())) >> np.uint64(64 - SKETCH)).astype(np.uint32), return_counts=True)
            sketch[at] += times.astype(np.uint32)
            used = True
            none = [None] * len(sets)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "_hash": batch.column("_hash"), "n": [len(s) for s in sets], "sig": [g[0] for g in sigs], "chk": [g[1] for g in sigs], "parity": [_parity(s) for s in sets], "block": none, "counts": none}, schema=arrow)
        if used:
            for block, part in enumerate(np.split(sketch, SKETCH_BLOCKS)):
                yield pa.RecordBatch.from_pydict({name: [{"block": block, "counts": zlib.compress(part.tobytes(), 1)}.get(name)] for name in arrow.names}, schema=arrow)

    return rows.select("doc_id", "text", _row_key()[1]).mapInArrow(run, schema)


def _levels(summaries: DataFrame) -> tuple[np.ndarray, int]:
    """The sketch's counters, summed over tasks, as levels for the order: two for each doubling of what exceeds their mean, from
    three deviations on; and the level from which an element is hot.  One byte a counter: 4 MB."""

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for c in b.column("counts").to_pylist():
                part = np.frombuffer(zlib.decompress(c), np.uint32)
                total = part.astype(np.uint64) if total is None else np.add(total, part, out=total)
        yield pa.RecordBatch.from_pydict({"block": [key[0].as_py()], "counts": [zlib.compress(total.tobytes(), 1)]}, schema=pa.schema([("block", pa.int32()), ("counts", pa.binary())]))

    parts = summaries.filter("block is not null").select("block", "counts").groupBy("block").applyInArrow(add, "block int, counts binary").collect()
    counters = np.zeros(1 << SKETCH)
    width = len(counters) // SKETCH_BLOCKS
    for r in parts:
        counters[r["block"] * width : (r["block"] + 1) * width] = np.frombuffer(zlib.decompress(r["counts"]), np.uint64)
    # a counter holds the elements that meet in it by chance as well, about as many as the mean: what exceeds that counts
    mean = counters.mean()
    floor = 4 + 3 * math.sqrt(mean)
    level = lambda c: np.clip(np.floor(2 * np.log2(np.maximum(c - mean, 1e-9) / floor)) + 1, 0, 255)
    return level(counters).astype(np.uint8), int(level(np.array([mean + max(HOT, floor)]))[0])


def subset_sizes(n: int, boundary: int) -> list[int]:
    """The sizes of subsets that a light set of n elements lists: those that a light partner of b >= n asks for."""
    return sorted({needed(b) for b in range(n, boundary + 1) if 4 * n >= 3 * b})


def choose_boundary(sizes: dict[int, int]) -> int:
    """The boundary with the least cost, from counts of sets by size; sizes over LARGEST_BOUNDARY may be summed up."""
    entries = sum(k * (n - needed(n) + 1) for n, k in sizes.items() if n)
    scanned = 1 + entries / (1 << SKETCH)  # sets met on a list, as the sketch's counters hold them

    def cost(x: int) -> float:
        light = sum(sizes.get(n, 0) * sum(math.comb(n, c) for c in subset_sizes(n, x)) for n in range(1, x + 1))
        return light + sum(k * (n - needed(n) + 1) * scanned for n, k in sizes.items() if n and 4 * n >= 3 * (x + 1))

    return min(range(LARGEST_BOUNDARY + 1), key=lambda x: (cost(x), x))


def _entries(s: np.ndarray, levels: np.ndarray, boundary: int):
    """(key, place, hot level) of a set's list entries; subsets have place -1."""
    n = len(s)
    keys, places, rank = [], [], []
    if 4 * n >= 3 * (boundary + 1):
        level = levels[(s >> np.uint64(64 - SKETCH)).astype(np.int64)]
        order = np.lexsort((s, level))[: n - needed(n) + 1]
        keys.append(s[order])
        places.append(np.arange(len(order)))
        rank.append(level[order])
    if n <= boundary:
        for c in subset_sizes(n, boundary):
            subsets = np.array(list(combinations(range(n), c)))
            keys.append(mix(np.add.reduce(mix(s[subsets] + np.uint64(c)), axis=1)))
            places.append(np.full(len(subsets), -1))
            rank.append(np.zeros(len(subsets), dtype=np.uint8))
    return np.concatenate(keys), np.concatenate(places), np.concatenate(rank)


def _lists(rows: DataFrame, levels: np.ndarray, hot: int, boundary: int, buckets: int, collided: frozenset[int]) -> DataFrame:
    """Packed list entries by bucket: the sets (sig, n) of a batch; key (its upper 32 bits), set number and place of each entry.

    Two keys of a bucket that share 32 bits only make a list of candidates too long.  A place over 65,535 counts as that.
    """
    bounded_batches(rows.sparkSession)
    schema = "bucket long, hot boolean, sigs binary, sizes binary, keys binary, owners binary, places binary"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    shared = rows.sparkSession.sparkContext.broadcast(levels)  # 2 ** SKETCH bytes, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = {_identity(s, collided): s for s in map(shingle_set, batch.column("text").to_pylist()) if len(s)}
            if not sets:
                continue
            made = [_entries(s, shared.value, boundary) for s in sets.values()]
            owner = np.repeat(np.arange(len(made), dtype=np.uint16), [len(k) for k, _, _ in made])
            key, place, rank = (np.concatenate([m[i] for m in made]) for i in range(3))
            sig, size = np.array(list(sets), dtype=np.int64), np.array([len(s) for s in sets.values()], dtype=np.int32)
            del made, sets
            is_hot = rank >= hot
            spread = np.where(is_hot, mix(sig[owner].view(np.uint64)) % np.uint64(SALTS), np.uint64(0))
            part_of = 2 * (mix(key + spread) % np.uint64(buckets)).astype(np.int64) + is_hot
            order = np.argsort(part_of, kind="stable")
            edges = np.flatnonzero(np.diff(part_of[order], prepend=-1))
            out: dict[str, list] = {name: [] for name in arrow.names}
            for part in np.split(order, edges[1:]):
                own, number = np.unique(owner[part], return_inverse=True)
                values = (int(part_of[part[0]]) >> 1, bool(is_hot[part[0]]), sig[own].tobytes(), size[own].tobytes(), (key[part] >> np.uint64(32)).astype(np.uint32).tobytes(), number.astype(np.uint16).tobytes(), np.clip(place[part], -1, 65_534).astype(np.uint16).tobytes())
                for name, v in zip(out, values):
                    out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return rows.select("text").mapInArrow(run, schema)


def _passes(na, pa_, nb, pb):
    """Size and position bounds: the sets may link if this is the first element they share."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    ahead = np.minimum(na - np.maximum(pa_, 0), nb - np.maximum(pb, 0))
    return (4 * small >= 3 * large) & ((pa_ < 0) | (7 * ahead >= 3 * (na + nb)))


_PAIR_SCHEMA = "a long, b long, list long"
_PAIR_ARROW = pa.schema([(name, pa.int64()) for name in ("a", "b", "list")])


def _bucket_pairs(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b; list null) of a bucket's lists with their first sets; and the entries (a, list) of lists that these pairs
    do not exhaust, lists of the same sets once.  A hot element's list is numbered by its key, so that its parts of other buckets join it."""
    sig, n, keys, place, hot = [], [], [], [], []
    for b in batches:
        for warm, sigs, sizes, ks, owners, places in zip(*(b.column(c).to_pylist() for c in ("hot", "sigs", "sizes", "keys", "owners", "places"))):
            own = np.frombuffer(owners, np.uint16)
            sig.append(np.frombuffer(sigs, np.int64)[own])
            n.append(np.frombuffer(sizes, np.int32)[own])
            keys.append(np.frombuffer(ks, np.uint32))
            place.append(np.frombuffer(places, np.uint16))
            hot.append(np.full(len(own), warm))
    sig, n, keys, place, hot = map(np.concatenate, (sig, n, keys, place, hot))
    # elements of one set alone go first: most of them; a hot element has other sets in other buckets
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    shared = order[np.concatenate((same, [False])) | np.concatenate(([False], same)) | hot[order]]
    sig, n, keys, place, hot = sig[shared], n[shared].astype(np.int64), keys[shared], place[shared].astype(np.int64), hot[shared]
    place[place == 65_535] = -1
    order = np.lexsort((place, sig, keys))
    sig, n, keys, place, hot = sig[order], n[order], keys[order], place[order], hot[order]
    first = np.ones(len(sig), dtype=bool)
    first[1:] = (keys[1:] != keys[:-1]) | (sig[1:] != sig[:-1])
    sig, n, keys, place, hot = sig[first], n[first], keys[first], place[first], hot[first]
    if not len(sig):
        return
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    lengths = np.diff(np.append(starts, len(keys)))
    lead, rank = np.repeat(starts, lengths), np.arange(len(keys)) - np.repeat(starts, lengths)
    left, right = [], []
    for k in range(LEADERS):  # each member with the list's first sets; sigs are hashes, so these are any sets
        ahead = np.flatnonzero(rank > k)
        left.append(lead[ahead] + k)
        right.append(ahead)
    a, b = np.concatenate(left), np.concatenate(right)
    ok = _passes(n[a], place[a], n[b], place[b])
    pairs = np.unique(np.stack([sig[a[ok]], sig[b[ok]]], axis=1), axis=0)
    merged: dict[tuple[int, bytes], tuple[int, slice]] = {}
    bucket = key[0].as_py()
    for at, length in zip(starts.tolist(), lengths.tolist()):
        if length > LEADERS + 1 or hot[at]:
            own = slice(at, at + length)
            number = int(keys[at]) if hot[at] else (bucket + 1) << 32 | int(keys[at])
            merged.setdefault((number if hot[at] else 0, sig[own].tobytes()), (number, own))
    none = np.empty(0, dtype=np.int64)
    member = np.concatenate([none, *(sig[own] for _, own in merged.values())])
    number = np.concatenate([none, *(np.full(own.stop - own.start, number) for number, own in merged.values())])
    k, m = len(pairs), len(member)
    is_pair = np.arange(k + m) < k
    yield pa.RecordBatch.from_arrays([
        pa.array(np.concatenate((pairs[:, 0], member))), pa.array(np.concatenate((pairs[:, 1], np.zeros(m, dtype=np.int64))), mask=~is_pair),
        pa.array(np.concatenate((np.zeros(k, dtype=np.int64), number)), mask=is_pair),
    ], schema=_PAIR_ARROW)


def _plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), differ that pass the bound of sizes and parity sketches: the sketches' difference, never more
    than the sets', leaves the threshold in reach."""
    side = lambda x: sets.select(F.col("sig").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}"))
    both = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").filter(4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb"))

    def near(a: list[int], b: list[int], na: list[int], nb: list[int], pa: list[bytes], pb: list[bytes]) -> dict:
        out = {"a": [], "b": [], "differ": []}
        for x, y, n, m, p, q in zip(a, b, na, nb, pa, pb):
            words = min(len(p), len(q)) // 8
            differ = int(np.bitwise_count(_folded(np.frombuffer(p, np.uint64), words) ^ _folded(np.frombuffer(q, np.uint64), words)).sum())
            if 7 * differ <= n + m:  # |A| + |B| - 2 i <= (|A| + |B|) / 7 at the threshold
                for k, v in zip(out, (x, y, differ)):
                    out[k].append(v)
        return out

    return map_rows(both, ["a", "b", "na", "nb", "pa", "pb"], near, "a long, b long, differ long")


def _texts(sigs: DataFrame, rows: DataFrame, sets: DataFrame, collided: frozenset[int]) -> DataFrame:
    """sig and z, one text of each set compressed, which is less than its hashes.

    Up to ``BROADCAST_SETS`` sets' row keys are broadcast; more are joined, and a filter of fixed size keeps most other texts from moving."""
    key = ["_id", "_hash"]
    wanted = shared_checkpoint(sigs.distinct().join(sets.select("sig", "rep._id", "rep._hash"), "sig"))
    keyed = rows.select("text", *_row_key())
    if wanted.count() <= BROADCAST_SETS:
        found = keyed.join(F.broadcast(wanted), key)
    else:
        found = may_be_in(keyed, key, filter_of(wanted, key)).filter("_in").drop("_in").join(wanted, key)

    def squeeze(sigs: list[int], texts: list[str]) -> dict:
        tool = zstandard.ZstdCompressor(level=3)
        # the text must be the one with this set: a doc_id may have several rows, and many rows may have none
        good = [(s, tool.compress(t.encode())) for s, t in zip(sigs, texts) if _identity(shingle_set(t), collided) == s]
        return {"sig": [g[0] for g in good], "z": [g[1] for g in good]}

    return map_rows(found, ["sig", "text"], squeeze, "sig long, z binary").groupBy("sig").agg(F.first("z").alias("z"))


def _verified(pairs: DataFrame, rows: DataFrame, sets: DataFrame, collided: frozenset[int]) -> DataFrame:
    """The pairs whose whole sets reach the threshold."""
    # dealt by sig once for both joins, so that of each pair only b's text moves again
    texts = _texts(pairs.select(F.col("a").alias("sig")).union(pairs.select("b")), rows, sets, collided)
    side = lambda x: texts.select(F.col("sig").alias(x), F.col("z").alias(f"z{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")

    def compare(a: list[int], b: list[int], za: list[bytes], zb: list[bytes]) -> dict:
        tool = zstandard.ZstdDecompressor()
        last, own, out = None, None, {"a": [], "b": []}
        for x, y, z, w in zip(a, b, za, zb):
            if x != last:  # pairs come sorted by a
                last, own = x, shingle_set(tool.decompress(z).decode())
            other = shingle_set(tool.decompress(w).decode())
            shared = len(np.intersect1d(own, other, assume_unique=True))
            if 7 * shared >= 3 * (len(own) + len(other)):
                out["a"].append(x)
                out["b"].append(y)
        return out

    return shared_checkpoint(map_rows(both, ["a", "b", "za", "zb"], compare, "a long, b long"))


def _compare_blocks(nearest: bool):
    """(a, b, differ): sets outside their unit's largest component, each with those of other components that sizes and
    sketches do not refute, the nearest one or all."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        number = lambda name: table.column(name).to_numpy()
        sig, n, comp = (number(c) for c in ("sig", "n", "component"))
        raw = table.column("parity").to_pylist()
        words = np.array([len(p) // 8 for p in raw])
        row = np.empty(len(raw), dtype=np.int64)  # its row in the matrix of sketches of its length
        parity = {}
        for w in np.unique(words).tolist():
            own = np.flatnonzero(words == w)
            row[own] = np.arange(len(own))
            parity[w] = {w: np.frombuffer(b"".join(raw[k] for k in own), np.uint64).reshape(-1, w)}
        del raw

        def sketches(w: int, folded: int) -> np.ndarray:
            if folded not in parity[w]:
                parity[w][folded] = _folded(parity[w][w], folded)
            return parity[w][folded]

        block = np.stack([number("main"), number("ob"), number("mb")])
        order = np.lexsort(block)
        edges = np.flatnonzero((np.diff(block[:, order], axis=1) != 0).any(axis=0)) + 1
        outside = number("outside")
        found = [np.empty((0, 3), dtype=np.int64)]
        for part in np.split(order, edges):
            every = part[outside[part] == 0]
            for o in part[outside[part] == 1].tolist():
                other = every[(comp[every] != comp[o]) & (4 * np.minimum(n[every], n[o]) >= 3 * np.maximum(n[every], n[o]))]
                if not len(other):
                    continue
                differ = np.empty(len(other), dtype=np.int64)
                for w in np.unique(words[other]).tolist():
                    at, low = np.flatnonzero(words[other] == w), min(w, int(words[o]))
                    differ[at] = np.bitwise_count(sketches(w, low)[row[other[at]]] ^ sketches(int(words[o]), low)[row[o]]).sum(axis=1, dtype=np.int64)
                ok = np.flatnonzero(7 * differ <= n[o] + n[other])
                if len(ok):
                    ok = ok[np.argmin(differ[ok])][None] if nearest else ok
                    found.append(np.stack([np.full(len(ok), sig[o]), sig[other[ok]], differ[ok]], axis=1))
        rows = np.unique(np.concatenate(found), axis=0)
        if nearest:  # of all units here
            rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
            rows = rows[np.unique(rows[:, 0], return_index=True)[1]]
        yield pa.RecordBatch.from_pydict({"a": rows[:, 0], "b": rows[:, 1], "differ": rows[:, 2]}, schema=_APART)

    return run


_APART = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("differ", pa.int64())])


def _nearest(pairs: DataFrame, of: str) -> DataFrame:
    """Of each set in column of, the pair that differs least."""
    other = "a" if of == "b" else "b"
    return pairs.groupBy(of).agg(F.min(F.struct("differ", other)).alias("_m")).select(of, f"_m.{other}", "_m.differ").select("a", "b", "differ")


def _crossing(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """The pairs whose sets lie in different components so far."""
    side = lambda x: of.select(F.col("sig").alias(x), F.col("component").alias(f"_c{x}"))
    known = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return known.filter(F.coalesce("_ca", "a") != F.coalesce("_cb", "b")).select("a", "b", "differ")


def _apart(members: DataFrame, of: DataFrame, sets: DataFrame, nearest: bool) -> DataFrame | None:
    """Pairs to verify of lists that lie in several components; None without such lists.

    Lists with one largest component are one unit, in which a set stands once however many of them hold it: near copies share
    many lists.  A unit is cut into blocks, of its sets outside that component by all of its sets, so no task holds a whole one."""
    known = members.select("list", "sig").join(of, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    shares = known.groupBy("list", "component").agg(F.count(F.lit(1)).alias("k"))
    mixed = shares.groupBy("list").agg(F.max(F.struct("k", "component")).alias("top"), F.sum("k").alias("all")).filter("all > top.k").select("list", F.col("top.component").alias("main"))
    units = shared_checkpoint(known.join(mixed, "list").select("main", "sig", "component").distinct())
    blocks = lambda rows, size: F.ceil(rows / size).cast("int")
    sizes = units.groupBy("main").agg(blocks(F.count_if(F.col("component") != F.col("main")), BLOCK_OUTSIDE).alias("_ob"), blocks(F.count(F.lit(1)), BLOCK_ALL).alias("_mb"), F.count(F.lit(1)).alias("_all"))
    rows = sizes.agg(F.sum(F.col("_all") * F.col("_ob"))).first()[0]
    if not rows:
        return None
    small = map_rows(sets, ["sig", "n", "parity"], _coarse, "sig long, n long, parity binary")
    left = units.join(sizes.filter("_ob > 0"), "main").join(small, "sig").withColumn("_h", F.xxhash64("sig"))
    every = F.transform(F.sequence(F.lit(0), F.col("_ob") - 1), lambda k: F.struct(k.alias("ob"), F.pmod("_h", "_mb").cast("int").alias("mb"), F.lit(0).alias("outside")))
    alone = F.transform(F.sequence(F.lit(0), F.col("_mb") - 1), lambda k: F.struct(F.pmod("_h", "_ob").cast("int").alias("ob"), k.alias("mb"), F.lit(1).alias("outside")))
    none = F.slice(alone, F.lit(1), F.lit(0))
    dealt = left.select("main", "sig", "n", "component", "parity", F.explode(F.concat(every, F.when(F.col("component") != F.col("main"), alone).otherwise(none))).alias("_b")).select("*", "_b.*").drop("_b")
    buckets = max(LEAST_BUCKETS, math.ceil(2 * rows / ROWS_A_BLOCK_BUCKET))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("main", "ob", "mb"), F.lit(buckets)))
    found = dealt.groupBy("bucket").applyInArrow(_compare_blocks(nearest), "a long, b long, differ long")
    return _plausible(found, sets)  # by the whole sketches


def _edges(of: DataFrame) -> DataFrame:
    return of.select(F.col("sig").alias("u"), F.col("component").alias("v"))


def _joined(links: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """sig and component of all sets that links, and the components so far, join."""
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    return shared_checkpoint(components(edges if of is None else edges.union(_edges(of))).withColumnRenamed("node", "sig"))


def jaccard_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(own, of): own has doc_id, text hash, n and sig of each row, equal sets sharing a sig; of has the component of each sig
    that links to another, both checkpointed."""
    rows = id_text(docs)
    summaries = shared_checkpoint(_summaries(rows))
    own = summaries.filter("block is null").select("doc_id", "_hash", "n", "sig", "chk", "parity")
    # two sets with one 64-bit identity: none, or a few in 10 ** 10
    double = own.filter("n > 0").groupBy("sig").agg(F.min("chk").alias("_l"), F.max("chk").alias("_h")).filter("_l != _h").select("sig")
    collided = frozenset(r["sig"] for r in double.toLocalIterator())
    if collided:
        own = own.withColumn("sig", F.when(F.col("sig").isin(list(collided)), F.col("chk")).otherwise(F.col("sig")))
    sets = own.filter("n > 0").groupBy("sig").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(TOP)).alias("_id"), "_hash")).alias("rep"), F.first("n").alias("n"), F.first("parity").alias("parity"))
    sizes = {r["s"]: (r["k"], r["e"]) for r in sets.groupBy(F.least("n", F.lit(2 * LARGEST_BOUNDARY)).alias("s")).agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("n") - F.ceil(F.col("n") * 0.75) + 1).alias("e")).collect()}
    levels, hot = _levels(summaries)
    boundary = choose_boundary({s: k for s, (k, _) in sizes.items()})
    buckets = max(LEAST_BUCKETS, math.ceil(sum(e for _, e in sizes.values()) / ENTRIES_A_BUCKET))
    lists = _lists(rows, levels, hot, boundary, buckets, collided)
    found = shared_checkpoint(lists.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_bucket_pairs, _PAIR_SCHEMA))
    members = found.filter("list is not null").select("list", F.col("a").alias("sig"))
    pairs = found.filter("list is null").select("a", "b")
    if any(hot <= level for level in np.unique(levels)):  # the parts of hot lists meet in their least sets
        tops = members.filter(F.col("list") < 1 << 32).groupBy("list").agg(F.min("sig").alias("a"))
        pairs = pairs.union(members.join(tops, "list").filter("sig != a").select("a", F.col("sig").alias("b")))
    sets = shared_checkpoint(members.select("sig").union(pairs.select("a")).union(pairs.select("b")).distinct().join(sets, "sig"))  # the others link to nothing
    pool = shared_checkpoint(_plausible(pairs, sets))
    tested = shared_checkpoint(_nearest(pool, "b").select("a", "b"))  # joins most of a group of near copies, one text a set
    of = _joined(_verified(tested, rows, sets, collided))
    ordered = lambda found: found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for nearest in (True, False):
        left = _crossing(pool.join(tested, ["a", "b"], "left_anti"), of)
        apart = _apart(members, of, sets, nearest)
        if nearest:
            left = _nearest(left, "b")
            apart = None if apart is None else _nearest(apart, "a")
        left = ordered(left if apart is None else left.union(apart))
        more = shared_checkpoint(left.join(tested, ["a", "b"], "left_anti"))
        if not more.isEmpty():
            of = _joined(_verified(more, rows, sets, collided), of)
            tested = tested.union(more)
        elif apart is None:
            break
    return own.select("doc_id", "_hash", "n", "sig"), of


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links, itself included) of each row.

    Two rows link when 100 * intersection >= 75 * union of their shingle sets.  A row without words, null or empty,
    has no shingles and is its own component.  Rows that repeat a doc_id count as separate rows of that id.  A null
    doc_id takes part; its component is the least id that is not null, or null.  An empty table gives no rows; other
    columns are ignored.
    """
    own, of = jaccard_classes(docs)
    placed = own.filter("n > 0").select("doc_id", "n", "sig").join(of.withColumnRenamed("component", "_c"), "sig", "left").withColumn("_c", F.coalesce("_c", "sig"))
    least = placed.groupBy("_c").agg(F.min("doc_id").alias("component_id"))
    linked = placed.join(least, "_c").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.union(own.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of linked rows: the least doc_id's (null counts above all), one of equals.

    Other rows that repeat a doc_id, or have none, are judged by their own texts.  Rows without words, null or empty, all stay.  All columns are
    kept, whatever their names.
    """
    own, of = jaccard_classes(docs)
    placed = own.filter("n > 0").select(F.coalesce("doc_id", F.lit(TOP)).alias("_id"), "_hash", "sig").join(of.withColumnRenamed("component", "_c"), "sig", "left").withColumn("_c", F.coalesce("_c", "sig"))
    rows = placed.groupBy("_c", "_id", "_hash").agg(F.count(F.lit(1)).alias("_rows"))
    least = rows.groupBy("_c").agg(F.min(F.struct("_id", "_hash")).alias("_least"), F.sum("_rows").alias("_k")).filter("_k > 1")
    grouped = shared_checkpoint(rows.join(least, "_c").select("_id", "_hash", "_rows", (F.struct("_id", "_hash") == F.col("_least")).alias("_stays")))
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), *_row_key())
    kept = anti_join(keyed, grouped.filter("not _stays").select("_id", "_hash"), ["_id", "_hash"])
    return _one_of_equal_rows(kept, grouped.filter("_stays and _rows > 1").select("_id", "_hash")).select("_row.*")


def _one_of_equal_rows(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """rows with one row, the least, of each id and text in repeated; most inputs have none."""
    if repeated.isEmpty():
        return rows
    key = ["_id", "_hash"]
    one = rows.join(repeated, key, "left_semi").groupBy(*key).agg(F.min("_row").alias("_row"))
    return rows.join(repeated, key, "left_anti").unionByName(one)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))

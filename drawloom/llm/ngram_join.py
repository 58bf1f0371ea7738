"""N-gram Jaccard join with prefix trees.

A document's set holds the distinct shingles of five words (64-bit fingerprints of them; fewer words: the whole
sequence as one). Two documents link at a Jaccard similarity of ``NUM / DEN`` or more. The result is each document's
component under these links.

1. Documents with equal sets are one class. Only classes take part from here on.
2. A linked set of size n has at most ``n - ceil(n * NUM / DEN)`` shingles that its partner lacks. So a class with more
   shingles that occur in no other class is settled as alone. Uniqueness is tested on a fixed zone of the fingerprint
   space (5/16), which is enough to settle most classes and keeps the shuffle small.
3. The open classes get one global order of shingles, by frequency among them. Two linked sets share a shingle among
   their first ``n - ceil(n * NUM / DEN) + 1`` (the prefix). Unique shingles come first and bring no partner, and may
   settle more classes. What can still follow bounds the overlap, and pairs below the bound are dropped.
4. In a few rounds each shingle's classes are compared with one of them (the star of the shingle), which ties large
   groups of near copies together without their pairs. Then the classes of each shingle meet in blocks. Parity bitmaps
   of the sets bound their symmetric difference from below; classes of different components that may still link form
   groups, and a group found under many shingles is compared once. No pair leaves a task before it is verified.
5. A comparison takes one set against others held in a prefix tree. The walk shares the overlap of common paths and
   leaves a subtree once the lengths that remain cannot reach the threshold. The overlap is exact. In groups a union-find
   leaves out sets of the own component, as their links change nothing: a group gives fewer links than it has members.

A star with very many partners is split into blocks of bounded size; tables go to the shared folder between steps.

Null and empty texts and texts of white space have no shingles and are alone; a null doc_id is alone and has a null
component; repeated rows share a class; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawloom.llm.common import map_batches, release_memory, shuffle_width, small_side, stored

NUM, DEN = 3, 4
WORDS = 5
#: Fingerprints whose low byte is below this are the zone.
ZONE = 80
#: A prefix tree holds at most so many sets and about so many shingles.
BLOCK_SETS, BLOCK_SHINGLES = 256, 1_000_000
#: 64-bit words of the parity bitmap, and rounds of stars.
BITMAP, ROUNDS = 8, 2
_MAPS = [f"m{k}" for k in range(BITMAP)]
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a word that are hashed with those of all others; longer words are taken alone.
LONG_WORD = 64
#: The low bytes of a 64-bit word, by their number.
_BYTES = np.array([256**k - 1 for k in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing step of a common 64-bit hash (fixed values)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of a text column, and where each text's words begin. A null text has no words.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, hashed in steps of eight bytes that start from the length.
    """
    column = column.fill_null("").cast(pa.large_string())
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
    starts = starts - starts[0]
    inside = (data != 32) & (data - np.uint8(9) > 4)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    own = starts[:-1][starts[:-1] < starts[1:]]  # a word ends with its text
    first[own] = inside[own]
    own = starts[1:][starts[:-1] < starts[1:]] - 1
    last[own] = inside[own]
    first, last = np.flatnonzero(first), np.flatnonzero(last) + 1
    low = np.concatenate([data + ((data - np.uint8(65) < 26).view(np.uint8) << 5), np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", low, strides=(1,))  # the bytes from each place on
    size = last - first
    hashes = size.astype(np.uint64) * _STEP
    some = np.flatnonzero(size <= LONG_WORD)
    for k in range(0, LONG_WORD, 8):
        if not len(some):
            break
        hashes[some] = mixed(hashes[some] ^ (eight[first[some] + k] & _BYTES[np.minimum(size[some] - k, 8)]))
        some = some[size[some] > k + 8]
    for i in np.flatnonzero(size > LONG_WORD):
        hashes[i] = xxhash.xxh3_64_intdigest(low[first[i] : last[i]].tobytes())
    return hashes, np.searchsorted(first, starts)


def shingle_sets(column: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints of each text, one text behind the other, and where each begins."""
    each, starts = word_hashes(column)
    begin, words = starts[:-1], np.diff(starts)
    total = np.zeros(len(each), np.uint64)
    keep = np.ones(len(each), bool)
    rolled = each[: max(0, len(each) - size + 1)] + np.uint64(size)
    for k in range(1, size):
        rolled = rolled * _STEP + each[k : len(rolled) + k]
        keep[starts[1:][words >= size] - k] = False
    total[: len(rolled)] = rolled
    # A shorter text is one shingle.
    for width in range(1, size):
        where = begin[words == width]
        value = each[where] + np.uint64(width)
        for k in range(1, width):
            value = value * _STEP + each[where + k]
            keep[where + k] = False
        total[where] = value
    values = mixed(total[keep]).view(np.int64)
    places = np.append(0, np.cumsum(keep))[starts]
    for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[places[:-1][places[:-1] < places[1:]]] = True
    return values[new], np.append(0, np.cumsum(new))[places]


def in_zone(x: np.ndarray) -> np.ndarray:
    return (x & 255) < ZONE


def _sums(x: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.diff(np.append(np.zeros(1, x.dtype), np.cumsum(x, dtype=x.dtype))[places])


def digests(values: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free sums over each set, with its size."""
    u = values.view(np.uint64)
    first = _sums(mixed(u + _STEP), places) + np.diff(places).astype(np.uint64)
    return first.view(np.int64), _sums(mixed(u * _STEP), places).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


def summaries(docs: DataFrame) -> DataFrame:
    """doc_id, set size and digests of every document."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, places = shingle_sets(batch.column("text"))
        columns = [batch.column("doc_id").cast(pa.int64()), *map(pa.array, (np.diff(places), *digests(values, places)))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "d1", "d2"])

    return map_batches(docs.select("doc_id", "text"), one, "doc_id long, n long, d1 long, d2 long")


def zone_rows(docs: DataFrame) -> DataFrame:
    """One row per document and zone shingle: token, d1."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, places = shingle_sets(batch.column("text"))
        keys = np.repeat(digests(values, places)[0], np.diff(places))
        zone = in_zone(values)
        return pa.RecordBatch.from_arrays([pa.array(values[zone]), pa.array(keys[zone])], ["token", "d1"])

    return map_batches(docs.filter("doc_id is not null").select("text"), one, "token long, d1 long")


def bitmap(x: np.ndarray) -> np.ndarray:
    """Parity of the set's shingles in ``64 * BITMAP`` cells; unequal cells never outnumber the symmetric difference."""
    odd = np.bincount((x >> 8) & (64 * BITMAP - 1), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def class_sets(docs: DataFrame) -> DataFrame:
    """The whole sets of some documents; rows whose text is not that of the class go."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        values, places = shingle_sets(batch.column("text"))
        same = digests(values, places)[0] == batch.column("k").to_numpy()
        sets = np.split(values, places[1:-1])
        keep = [(k, s) for k, s, own in zip(batch.column("k").to_pylist(), sets, same, strict=True) if own]
        if not keep:
            return None
        maps = np.stack([bitmap(s) for _, s in keep])
        columns = [pa.array([k for k, _ in keep], pa.int64()), pa.array([len(s) for _, s in keep], pa.int64()), _lists([s for _, s in keep]), *(pa.array(m) for m in maps.T.copy())]
        return pa.RecordBatch.from_arrays(columns, ["k", "n", "sh", *_MAPS])

    return map_batches(docs, one, "k long, n long, sh array<long>, " + ", ".join(f"{m} long" for m in _MAPS))


def prefix_size(n):
    return n - F.ceil(n * NUM / DEN) + 1


def open_classes(summary: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All classes (k, n, rep, members), and those that unique zone shingles do not settle."""
    classes = stored(summary.filter("n > 0 and doc_id is not null").groupBy(F.col("d1").alias("k"), "d2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members")))
    tokens = zone_rows(docs).groupBy("token").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi"))
    unique = tokens.filter("lo = hi").groupBy(F.col("lo").alias("k")).agg(F.count(F.lit(1)).alias("alone"))
    still = classes.join(unique, "k", "left").filter(F.coalesce("alone", F.lit(0)) < prefix_size(F.col("n")))
    return classes, stored(still.select("k", "n", "rep"))


def prefixes(sets: DataFrame) -> DataFrame:
    """One row per class and prefix shingle: token, k, n, and how many shingles at most can be shared from it on."""
    each = sets.select("k", F.explode("sh").alias("token"))
    often = stored(each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
    shared = each.join(often, "token").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("order"))
    sized = shared.join(sets.select("k", "n"), "k").withColumn("shared", F.size("order"))
    length = prefix_size(F.col("n")) - (F.col("n") - F.col("shared"))
    kept = sized.filter(length > 0).select("k", "n", "shared", F.slice("order", F.lit(1), F.greatest(F.lit(0), length).cast("int")).alias("prefix"))
    return kept.select("k", "n", "shared", F.posexplode("prefix").alias("at", "p")).select("p.token", "k", "n", (F.col("shared") - F.col("at")).alias("left"))


def reachable(na, nb, overlap):
    """An overlap reaches the threshold: o / (na + nb - o) >= NUM / DEN."""
    return (NUM + DEN) * overlap >= NUM * (na + nb)


def labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Prefix rows with the component so far, for shingles that lie in several."""
    if labels is None:
        rows = rows.withColumn("label", F.col("k"))
    else:
        rows = stored(rows.join(labels.select(F.col("v").alias("k"), "label"), "k", "left").withColumn("label", F.coalesce("label", "k")))
    several = rows.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("token")
    return stored(rows.join(stored(several), "token", "left_semi"))


def star_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """Each class with one class of each of its prefix shingles, another one in each turn."""
    order = F.xxhash64(F.lit(turn), "k")
    centres = stored(rows.groupBy("token").agg(F.min(F.struct(order.alias("o"), F.col("k").alias("a"), F.col("n").alias("na"), F.col("left").alias("la"), F.col("label").alias("lab"))).alias("c")).select("token", "c.a", "c.na", "c.la", "c.lab"))
    pairs = rows.join(centres, "token").filter("label != lab").filter(reachable(F.col("na"), F.col("n"), F.least("la", "left")))
    return pairs.groupBy("a", F.col("k").alias("b")).agg(F.first("n").alias("nb"))


def block_groups(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Classes of different components that may link, as groups (members, labels), each group once.

    The classes of a shingle are dealt to blocks, and each two blocks meet in a task. There the bounds and bitmaps are
    tested, and classes that hang together by what is left are a group: no pair leaves the task.
    """
    sizes = rows.groupBy("token").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    own = F.pmod(F.xxhash64("k"), F.col("blocks"))
    dealt = rows.join(stored(sizes), "token").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.join(sets.select("k", *_MAPS), "k").select("token", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "k", "n", "left", "label", *_MAPS)
    spread = dealt.repartition(shuffle_width(rows.sparkSession), "token", "lo", "hi").sortWithinPartitions("token", "lo", "hi", "k")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = np.stack([batch.column(c).to_numpy() for c in ("token", "lo", "hi", "k", "n", "left", "label", *_MAPS)])
            table = table if rest is None else np.concatenate([rest, table], 1)
            cuts = np.flatnonzero((table[:3, 1:] != table[:3, :-1]).any(0)) + 1
            if len(cuts):
                yield _groups(table[:, : cuts[-1]])
                rest = table[:, cuts[-1] :]
            else:
                rest = table
        if rest is not None:
            yield _groups(rest)

    found = spread.mapInArrow(run, "members array<long>, labels array<long>")
    return found.groupBy("members").agg(F.first("labels").alias("labels"))


def _groups(table: np.ndarray) -> pa.RecordBatch:
    """Groups of the blocks in ``table`` (rows token, lo, hi, k, n, left, label and the bitmaps)."""
    cuts = np.flatnonzero((table[:3, 1:] != table[:3, :-1]).any(0)) + 1
    starts, ends = np.append(0, cuts), np.append(cuts, table.shape[1])
    members, labels = [], []
    # Blocks of equal size are compared together.
    for size in np.unique(ends - starts):
        if size < 2:
            continue
        of_size = starts[ends - starts == size]
        step = max(1, (1 << 18) // int(size) ** 2)
        for at in range(0, len(of_size), step):
            chosen = of_size[at : at + step, None] + np.arange(size)
            k, n, left, label = (table[r][chosen] for r in (3, 4, 5, 6))
            total = n[:, :, None] + n[:, None, :]
            near = (label[:, :, None] != label[:, None, :]) & ((NUM + DEN) * np.minimum(left[:, :, None], left[:, None, :]) >= NUM * total)
            apart = np.zeros(near.shape, np.int64)
            for m in range(7, 7 + BITMAP):
                bits = table[m][chosen].view(np.uint64)
                apart += np.bitwise_count(bits[:, :, None] ^ bits[:, None, :])
            near &= (NUM + DEN) * apart <= (DEN - NUM) * total
            for b in np.flatnonzero(near.any((1, 2))):
                for part in hanging(near[b]):
                    members.append(k[b][part])
                    labels.append(label[b][part])
    return pa.RecordBatch.from_arrays([_lists(members), _lists(labels)], ["members", "labels"])


def hanging(near: np.ndarray) -> list[np.ndarray]:
    """Connected parts of two or more in a square of marks."""
    left, parts = near.any(1), []
    while left.any():
        seen = np.zeros(len(near), bool)
        todo = seen.copy()
        todo[np.argmax(left)] = True
        while todo.any():
            seen |= todo
            todo = near[todo].any(0) & ~seen
        parts.append(np.flatnonzero(seen))
        left &= ~seen
    return parts


def block_links(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that tie components: each set of a group walks the group's prefix tree.

    The group's shingles are ordered by how many of its sets hold them, so near copies share long paths. A union-find
    over the components lets only links out that tie two of them: fewer than the group has members.
    """
    groups = stored(groups.withColumn("id", F.sha2(F.array_join("members", ","), 256)))
    each = groups.select("id", F.explode(F.arrays_zip("members", "labels")).alias("m")).select("id", F.col("m.members").alias("k"), F.col("m.labels").alias("label"))
    rows = each.join(sets.select("k", "sh"), "k").repartition(shuffle_width(groups.sparkSession), "id").sortWithinPartitions("id", "k")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            column = batch.column("sh")
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
            heads = (batch.column(c).to_pylist() for c in ("id", "k", "label"))
            for row, (name, k, label) in enumerate(zip(*heads, strict=True)):
                if name != group:
                    if held:
                        yield _pairs(tied(held))
                    group, held = name, []
                held.append((k, label, np.array(values[offsets[row] : offsets[row + 1]])))
        if held:
            yield _pairs(tied(held))
        release_memory()

    return rows.mapInArrow(run, "a long, b long")


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])


def tied(held: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links among sets (key, component, shingles) that tie two components not tied before."""
    vocabulary, inverse, counts = np.unique(np.concatenate([s for _, _, s in held]), return_inverse=True, return_counts=True)
    rank = np.empty(len(vocabulary), np.int64)
    rank[np.lexsort((vocabulary, -counts))] = np.arange(len(vocabulary))
    ordered = np.split(rank[inverse], np.cumsum([len(s) for _, _, s in held])[:-1])
    ordered = [np.sort(s) for s in ordered]
    tree = PrefixTree(list(enumerate(ordered)))
    places = np.argsort(tree.keys)
    _, start, counts = np.unique([held[i][1] for i in tree.keys], return_inverse=True, return_counts=True)
    own = start.copy()  # the component of each set, in the order of the tree
    out, left = [], len(counts) - 1
    # Of two sets of different components one at least is not in the largest, so its sets need no walk.
    for (k, _, _), s, me in zip(held, ordered, places, strict=True):
        if start[me] == np.argmax(counts):
            continue
        if not left:
            break
        for i in tree.links(s, lambda low, high, me=me: (own[low:high] != own[me]).any()):
            own[own == own[places[i]]] = own[me]
            out.append((k, held[i][0]))
            left -= 1
    return out


class PrefixTree:
    """Ordered sets in a tree with whole stretches on its edges; a node knows the set lengths below it."""

    def __init__(self, sets: list[tuple[int, np.ndarray]]) -> None:
        order = sorted(range(len(sets)), key=lambda i: (sets[i][1].view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").tobytes())
        self.keys = [sets[i][0] for i in order]
        self.sets = [sets[i][1] for i in order]
        self.root = self._node(0, len(self.sets), 0)

    def _node(self, low: int, high: int, depth: int) -> tuple[np.ndarray, int, list[int], list, int, int, int, int]:
        first, last = self.sets[low], self.sets[high - 1]
        size = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:size] != last[depth:size])
        end = depth + int(differ[0]) if len(differ) else size
        here, children, k = [], [], low
        while k < high and len(self.sets[k]) == end:
            here.append(k)
            k += 1
        while k < high:
            token, start = self.sets[k][end], k
            while k < high and self.sets[k][end] == token:
                k += 1
            children.append((start, k))
        nodes = [self._node(lo, hi, end) for lo, hi in children]
        lengths = [end] * bool(here) + [n[4] for n in nodes], [end] * bool(here) + [n[5] for n in nodes]
        return first[depth:end], end, here, nodes, min(lengths[0]), max(lengths[1]), low, high

    def links(self, query: np.ndarray, wanted: Callable[[int, int], bool] = lambda low, high: True, stretch: int = 128) -> Iterator[int]:
        """Keys of the sets that reach the threshold with ``query``, one by one as they are asked for.

        A subtree is left where ``wanted`` is false for its sets, a range of ``keys``.
        """
        todo, n = [(self.root, 0)], len(query)
        while todo:
            (edge, end, here, nodes, shortest, longest, low, high), overlap = todo.pop()
            if not wanted(low, high):
                continue
            depth = end - len(edge)
            for k in range(0, len(edge), stretch):
                part = edge[k : k + stretch]
                at = np.searchsorted(query, part)
                overlap += int((query[np.minimum(at, n - 1)] == part).sum())
                depth += len(part)
                left = n - int(np.searchsorted(query, part[-1], "right"))
                if (NUM + DEN) * (overlap + min(longest - depth, left)) < NUM * (n + shortest):
                    break
            else:
                if here and (NUM + DEN) * overlap >= NUM * (n + end):
                    yield from (self.keys[k] for k in here if wanted(k, k + 1))
                todo += [(node, overlap) for node in reversed(nodes)]


def _sets_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    column = batch.column("sh")
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    heads = (batch.column(c).to_pylist() for c in ("a", "block", "role", "k"))
    for row, (a, block, role, k) in enumerate(zip(*heads, strict=True)):
        yield a, block, role, k, values[offsets[row] : offsets[row + 1]]


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links: one set per block of partners walks a prefix tree of them."""
    pairs = stored(pairs)
    sizes = stored(pairs.groupBy("a").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("nb") / BLOCK_SHINGLES)).alias("blocks")))
    placed = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"))
    placed = stored(placed)
    one = sets.select("k", "sh")
    partners = placed.withColumnRenamed("b", "k").join(one, "k").select("a", "block", F.lit(1).alias("role"), "k", "sh")
    heads = stored(placed.select("a", "block").distinct()).withColumn("k", F.col("a")).join(one, "k").select("a", "block", F.lit(0).alias("role"), "k", "sh")
    rows = partners.unionByName(heads).repartition(shuffle_width(pairs.sparkSession), "a", "block").sortWithinPartitions("a", "block", "role")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, query, held, size, out = None, None, [], 0, []

        def walk() -> None:
            if held:
                out.extend((group[0], b) for b in PrefixTree(held).links(query))
                held.clear()

        for batch in batches:
            for a, block, role, k, s in _sets_of(batch):
                if (a, block) != group:
                    walk()
                    group, size = (a, block), 0
                if role == 0:
                    query = np.array(s)
                    continue
                held.append((k, np.array(s)))
                size += len(s)
                if len(held) >= 2 * BLOCK_SETS or size >= 2 * BLOCK_SHINGLES:
                    walk()
                    size = 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])
                out.clear()
        walk()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])
        release_memory()

    return rows.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(v, label): the smallest vertex that each vertex reaches. Labels jump to their labels' labels in each round."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.least("v", F.min("b")).alias("label")))
    while True:
        seen = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        step = stored(labels.join(seen, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        jump = step.select(F.col("v").alias("label"), F.col("label").alias("far"))
        moved = stored(step.join(jump, "label").select("v", "old", F.least("label", "far").alias("label")))
        labels = moved.select("v", "label")
        if moved.filter("label != old").isEmpty():
            return labels


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and the size of the class of equal sets."""
    docs = docs.select("doc_id", "text")
    summary = stored(summaries(docs))
    classes, still = open_classes(summary, docs)
    chosen = still.select(F.col("rep").alias("doc_id"), "k")
    sets = stored(class_sets(docs.join(small_side(chosen), "doc_id").select("k", "text")))
    if sets.count() > still.count():
        sets = stored(sets.dropDuplicates(["k"]))
    rows = stored(prefixes(sets))
    labels, edges = None, None
    for turn in range(ROUNDS + 1):
        apart = labelled(rows, labels)
        more = stored(verified(star_pairs(apart, turn), sets) if turn < ROUNDS else block_links(block_groups(apart, sets), sets))
        if not more.isEmpty():
            edges = more if edges is None else edges.unionByName(more)
            labels = components(edges)
    known = classes.select("k", "rep", "members")
    if labels is None:
        named = known.filter("members > 1").select("k", "members", F.col("rep").alias("component"))
    else:
        tied = stored(known.join(labels.withColumnRenamed("v", "k"), "k", "left").filter("members > 1 or label is not null").withColumn("label", F.coalesce("label", "k")))
        least = tied.groupBy("label").agg(F.min("rep").alias("component"))
        named = tied.join(least, "label").select("k", "members", "component")
    out = summary.select("doc_id", "n", F.col("d1").alias("k")).join(stored(named), "k", "left")
    alone = F.col("n") == 0
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "doc_id")).alias("component_id"),
        F.when(alone, F.lit(1)).otherwise(F.coalesce("members", F.lit(1))).alias("class_size"),
    )

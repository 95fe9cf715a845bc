"""N-gram Jaccard join: linked documents and their components.

Every text becomes the set of 64-bit hashes of its word n-grams.  Equal sets are
one class from the start.  The rest is exact:

1. A frequency sketch over all sets orders the shingles, frequent ones last.  Two
   sets whose Jaccard similarity reaches t share a shingle among the first
   n - ceil(t n) + 1 of each, so classes are posted under these only.
2. A shingle's classes are cut into size bands whose neighbours alone can link.
   Each class is compared with the first class of its own and of the next smaller
   band; that is linear in the postings and already joins nearly all copies.
3. In lists that still hold several components, size-banded tiles are compared
   in full: for two classes of different components, the bit count of the
   exclusive or of two hashed parity bitmaps is at most the number of shingles that
   only one has, which bounds their overlap from above.  First only the closest
   partner of each class in a tile is tried, twice, which joins what belongs together
   and hands on no more pairs than rows; then every pair of what is still apart.
   Lists over ``TILE`` classes are split into pairs of blocks that go to different tasks.
4. What the bound leaves is verified by exact intersection of the sorted arrays.

A pair inside one component needs no test, so a large group of near copies costs
its size, not its square, and no link between components is missed.

Defined cases: null, empty and wordless texts have the empty set and link with
nothing, not even with each other; fewer words than n give one shingle, the whole
sequence; repeated rows are kept, each with its component; null ids are kept but
are never the name of a component unless it has no other; an empty table gives an
empty table; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bridgerec.llm.blocks import row_blocks, text_bytes, whole_groups
from bridgerec.llm.chunk_table import ChunkTable
from bridgerec.llm.components import connected_components, merged_components
from bridgerec.llm.staging import Stage, fresh_name, maybe_broadcast, row_key, shuffle_partitions
from bridgerec.llm.word_hash import SPACED, mix, window_hashes, words_of

#: Counters of the frequency sketch (32-bit; one sketch a task, summed in a tree).
SKETCH_BITS = 18
#: A class's parity bitmap has twice as many bits as shingles, rounded up to a power of
#: two, and at least these; tiles compare them whole up to ``TILE_BITS``, which tells disjoint
#: sets of up to 7 / 4 ``TILE_BITS`` shingles apart; larger ones are folded to so many bits
#: there and told apart by the whole bitmaps later.
LEAST_BITS, TILE_BITS = 1024, 1 << 17
#: Classes of a list that are compared in one group.
TILE = 2048


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, without ties to a batch."""
    for a, b in row_blocks(offsets):
        words, _, _, counts = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], SPACED)
        grams = window_hashes(words, n)
        at = np.concatenate([[0], np.cumsum(counts)]).tolist()
        for i, k in enumerate(counts.tolist()):
            if k >= n:
                found = np.sort(grams[at[i] : at[i + 1] - n + 1])
                keep = np.ones(len(found), bool)
                keep[1:] = found[1:] != found[:-1]
                yield found[keep]
            elif k:
                yield window_hashes(words[at[i] : at[i + 1]], k)
            else:
                yield np.empty(0, np.uint64)


def fingerprint(shingles: np.ndarray) -> np.uint64:
    """64 bits that equal sets share."""
    return mix(np.array([mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64))[0]


def bitmap(shingles: np.ndarray) -> bytes:
    """Bit i tells whether an odd number of shingles hash to i."""
    bits = max(LEAST_BITS, 2 << (len(shingles) - 1).bit_length() if len(shingles) else 0)
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def tile_bitmap(whole: bytes) -> bytes:
    """A class's bitmap folded to what tiles compare."""
    return folded(np.frombuffer(whole, np.uint64)[None], min(len(whole) * 8, TILE_BITS) // 64).tobytes()


def tile_bitmaps(light: DataFrame) -> DataFrame:
    """(class, small) of ``light(class, bitmap)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = pa.array([tile_bitmap(m) for m in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), small], names=["class", "small"])

    return light.select("class", "bitmap").mapInArrow(run, "class long, small binary")


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Rows of bitmaps as ``words`` 64-bit words each: the bitmaps of so many fewer bits."""
    return np.bitwise_xor.reduce(maps.reshape(len(maps), -1, words), axis=1)


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc, id, n, class, bitmap) of each row and one sketch row for each task; a class has
    its bitmap once in a batch."""
    schema = T.StructType(
        [
            T.StructField("doc", T.LongType()),
            T.StructField("id", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("class", T.LongType()),
            T.StructField("bitmap", T.BinaryType()),
            T.StructField("sketch", T.BinaryType()),
        ]
    )
    types = pa.schema([(c, pa.int64()) for c in ("doc", "id", "n", "class")] + [(c, pa.binary()) for c in ("bitmap", "sketch")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ChunkTable.leave()
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            sizes, classes, maps, cells, seen = [], [], [], [], set()
            for s in shingle_sets(*text_bytes(batch.column(1)), n):
                sizes.append(len(s))
                classes.append(fingerprint(s))
                maps.append(None)
                if classes[-1] not in seen:  # a copy adds nothing to how rare a shingle is
                    seen.add(classes[-1])
                    maps[-1] = bitmap(s)
                    cells.append((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int32))
            sketch += np.bincount(np.concatenate([np.empty(0, np.int32), *cells]), minlength=len(sketch))
            cols = [batch.column(2), batch.column(0), pa.array(sizes, pa.int64()), pa.array(np.array(classes, np.uint64).view(np.int64))]
            cols += [pa.array(maps, pa.binary()), pa.nulls(batch.num_rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, schema=types)
        yield pa.RecordBatch.from_pylist([{"sketch": sketch.astype("<u4").tobytes()}], schema=types)

    return docs.mapInArrow(run, schema)


def _levels(sets: DataFrame) -> np.ndarray:
    """How frequent the shingles of each sketch cell are: 0 up to twice the mean, then by powers of two."""
    sketches = sets.filter("sketch is not null").select("sketch").rdd
    total = sketches.map(lambda r: np.frombuffer(r[0], "<u4").astype(np.int64)).treeReduce(np.add, depth=3)
    share = total / max(1.0, total.mean())
    return np.floor(np.log2(np.maximum(share, 1))).astype(np.uint8)


def _postings(docs: DataFrame, n: int, levels: np.ndarray, num: int, den: int) -> DataFrame:
    """(token, class, place) for the prefix of every class, once for each batch that has
    it; ``place`` is n << 32 plus the token's position in the order by rarity."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("token", "class", "place")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ChunkTable.leave()
        for batch in batches:
            seen: set = set()
            tokens, classes, sizes = [], [], []
            for s in shingle_sets(*text_bytes(batch.column(0)), n):
                if not len(s) or (c := fingerprint(s)) in seen:
                    continue
                seen.add(c)
                order = (levels[s >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(58)) | (s >> np.uint64(6))
                tokens.append(s[np.argsort(order, kind="stable")[: prefix_length(len(s), num, den)]])
                classes.append(c)
                sizes.append(len(s))
            if tokens:
                each = np.fromiter(map(len, tokens), np.int64, len(tokens))
                cols = [
                    np.concatenate(tokens).view(np.int64),
                    np.repeat(np.array(classes, np.uint64).view(np.int64), each),
                    (np.repeat(np.array(sizes), each) << 32) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=schema.names)

    return docs.select("text").mapInArrow(run, schema)


def _shared(postings: DataFrame, num: int, den: int) -> DataFrame:
    """The postings of shingles that two or more classes have, in size order, each
    with the class before it and the first class of its size band."""
    # sets of different bands can link only if the bands are neighbours
    n = F.shiftright("place", 32)
    rows = postings.withColumn("n", n).withColumn("band", F.floor(F.log("n") / math.log(den / num) + 1e-9))
    by_token = Window.partitionBy("token").orderBy("band", "n", "class")
    # copies of a set lie in several batches: a class is in a list once (the rows are in this order already)
    rows = rows.withColumn("same", F.lag("class").over(by_token)).filter("same is null or same != class").drop("same")
    by_band = Window.partitionBy("token", "band").orderBy("n", "class")
    near = rows.select(
        "token",
        "class",
        "place",
        "n",
        F.lag("class").over(by_token).alias("before"),
        F.lead("class").over(by_token).alias("after"),
        F.lag("n").over(by_token).alias("n_before"),
        F.lead("n").over(by_token).alias("n_after"),
        F.lag("place").over(by_token).alias("place_before"),
        F.lead("place").over(by_token).alias("place_after"),
        F.lag("class", 2).over(by_token).isNull().alias("second"),
        F.lead("class", 2).over(by_token).isNull().alias("last_but_one"),
        F.first("class").over(by_band.rowsBetween(Window.unboundedPreceding, 0)).alias("first"),
    )
    # sizes ascend, so a class that neither neighbour's size allows to link has no partner in the list
    fits_before = (F.col("before") != F.col("class")) & (den * F.col("n_before") >= num * F.col("n"))
    fits_after = (F.col("after") != F.col("class")) & (den * F.col("n") >= num * F.col("n_after"))
    # a list of two is one pair: here the places in both sets can be held against each other
    other = F.when(F.col("before").isNull() & F.col("last_but_one"), F.col("place_after"))
    other = other.when(F.col("after").isNull() & F.col("second"), F.col("place_before"))
    least = F.ceil(num * (F.col("n") + F.shiftright(other, 32)) / (num + den))
    room = [F.shiftright(p, 32) - p.bitwiseAND(F.lit(0xFFFFFFFF)) for p in (F.col("place"), other)]
    fits = other.isNull() | ((room[0] >= least) & (room[1] >= least))
    return near.filter((fits_before | fits_after) & fits).select("token", "class", "place", "before", "first")


def _arrays(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(class, hashes) of the documents whose ids are in ``wanted(row)``."""
    types = pa.schema([("class", pa.int64()), ("hashes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for s in shingle_sets(*text_bytes(batch.column(1)), n) if len(s)]
            rows = [(int(fingerprint(s).view(np.int64)), s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(types)], schema=types)

    wanted = maybe_broadcast(wanted.toDF("wanted"))
    texts = docs.join(wanted, F.col("row").eqNullSafe(F.col("wanted")), "left_semi")
    return texts.mapInArrow(run, "class long, hashes binary").dropDuplicates(["class"])


def _bounded(pairs: DataFrame, light: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that neither sizes nor bitmaps rule out."""
    types = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = (batch.column(i).to_numpy() for i in range(4))
            sizes = np.stack([pc.binary_length(batch.column(i)).to_numpy() // 8 for i in (4, 5)], axis=1)
            keep = np.zeros(len(a), bool)
            for pair in np.unique(sizes, axis=0):
                at = np.flatnonzero((sizes == pair).all(axis=1))
                maps = [batch.column(i).take(pa.array(at)).to_pylist() for i in (4, 5)]
                x, y = (np.frombuffer(b"".join(m), np.uint64).reshape(len(at), -1) for m in maps)
                least = int(pair.min())
                keep[at] = _may_link(folded(x, least) ^ folded(y, least), na[at] + nb[at], num, den)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], schema=types)

    left, right = (light.select("class", "n", "bitmap").toDF(side, f"n_{side}", f"m_{side}") for side in "ab")
    sized = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "m_a", "m_b")
    return sized.filter(f"{den} * least(n_a, n_b) >= {num} * greatest(n_a, n_b)").mapInArrow(run, "a long, b long")


def _may_link(differing: np.ndarray, total: np.ndarray, num: int, den: int) -> np.ndarray:
    """At least as many shingles are in one set alone as bits differ, so the overlap is
    at most (total - bits) / 2; a link needs den * overlap >= num * (total - overlap)."""
    apart = np.bitwise_count(differing).sum(axis=1, dtype=np.int64)
    return (num + den) * (total - apart) >= 2 * num * total


def _verified(near: DataFrame, docs: DataFrame, members: DataFrame, stage: Stage, name: str, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link, by intersection of the sorted arrays."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.sort(np.concatenate([x, y]))
                keep.append((num + den) * int((both[1:] == both[:-1]).sum()) >= num * len(both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    near = stage.write(near, f"near-{name}")
    if near.isEmpty():
        return near
    classes = near.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    # ids need not be unique: the classes of the fetched texts are computed again from the texts
    wanted = members.select("class", "row").join(classes, "class").select("row").distinct()
    arrays = stage.write(_arrays(docs, wanted, n), f"arrays-{name}")
    left, right = (arrays.select(F.col("class").alias(s), F.col("hashes").alias(f"h_{s}")) for s in "ab")
    both = near.join(left, "a").join(right, "b").select("a", "b", "h_a", "h_b")
    links = stage.write(both.mapInArrow(exact, "a long, b long"), f"links-{name}")
    stage.drop(f"near-{name}", f"arrays-{name}")
    return links


def _tiles(lists: DataFrame, light: DataFrame, num: int, den: int, closest: bool) -> DataFrame:
    """Distinct pairs of classes of different components that share a prefix shingle
    and that sizes, places and bitmaps do not rule out; with ``closest`` only the pair
    with the fewest differing bits for a class in a tile, and a row
    ``(null, null, token)`` for a list where that left pairs out.

    ``lists(token, class, place, component)``.  If a link's first common shingle is in
    place i of a set of n, at most n - i are common, which must be enough for the link
    in both sets; a pair that fails this here is met under an earlier shingle or not
    linked.  Of lists with the same members the one with the earliest shingle is
    compared.  A long list falls into k blocks by a hash of the class; a tile is a
    pair of blocks, and a class goes to its k tiles.
    """
    whole = lists.groupBy("token").agg(
        F.count("*").alias("m"),
        F.min("component").alias("lo"),
        F.max("component").alias("hi"),
        F.bit_xor(F.xxhash64("class")).alias("x"),
        F.bit_xor(F.xxhash64("class", F.lit(1))).alias("y"),
        F.sum(F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))).alias("places"),
    )
    mixed = whole.filter("lo != hi").groupBy("m", "x", "y").agg(F.min(F.struct("places", "token"))["token"].alias("token"))
    mixed = mixed.select("token", F.ceil(F.col("m") / TILE).cast("int").alias("k"))
    rows = lists.join(mixed, "token").join(tile_bitmaps(light), "class")
    block = F.pmod(F.xxhash64("class"), F.col("k")).cast("int")
    rows = rows.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select(
        "token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        "own", "place", "class", "component", "small",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ChunkTable.leave()
        for table, cuts in whole_groups(batches, 3):
            yield from compare(table, cuts)

    def compare(table: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        token, i, j, own, place, cls, comp = (table.column(k).to_numpy() for k in range(7))
        n = place >> 32
        room = n - (place & 0xFFFFFFFF)
        packed = table.column(7).to_pylist()
        words = np.fromiter(map(len, packed), np.int64, len(packed)) // 8
        found: list[np.ndarray] = []
        more: list[int] = []
        held = 0
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            order = a + np.lexsort((words[a:b], n[a:b]))
            ends = np.searchsorted(n[order], n[order] * den // num, side="right")
            maps = Folds(packed, order, words[order])
            for at, row in enumerate(order):
                k = np.arange(at + 1, ends[at])
                k = k[comp[order[k]] != comp[row]]
                if i[a] != j[a]:
                    k = k[own[order[k]] != own[row]]
                to = order[k]
                least = -(-num * (n[to] + n[row]) // (num + den))  # common shingles of a link
                fits = (room[to] >= least) & (room[row] >= least)
                k, to = k[fits], to[fits]
                if not len(to):
                    continue
                differing = maps.differing(at, k)
                near = _may_link(differing, n[to] + n[row], num, den)
                to = to[near]
                if closest and len(to) > 1:
                    apart = np.bitwise_count(differing[near]).sum(axis=1, dtype=np.int64)
                    more.append(int(token[a]))
                    to = to[np.lexsort((cls[to], apart))[:1]]
                one = np.full(len(to), cls[row])
                found.append(np.stack([np.minimum(one, cls[to]), np.maximum(one, cls[to])]))
                held += len(to)
                if held > 1 << 18:
                    yield distinct(found, more)
                    found, more, held = [], [], 0
        yield distinct(found, more)

    def distinct(found: list[np.ndarray], more: list[int]) -> pa.RecordBatch:
        both = np.unique(np.concatenate([np.empty((2, 0), np.int64), *found], axis=1), axis=1)
        again = sorted(set(more))
        cols = [pa.concat_arrays([pa.array(x), pa.nulls(len(again), pa.int64())]) for x in both]
        cols.append(pa.concat_arrays([pa.nulls(both.shape[1], pa.int64()), pa.array(again, pa.int64())]))
        return pa.RecordBatch.from_arrays(cols, names=["a", "b", "token"])

    order = ["token", "i", "j"]
    parts = shuffle_partitions(lists.sparkSession)
    tiles = rows.repartition(parts, *order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long, token long")
    return tiles.dropDuplicates()


class Folds:
    """Bitmaps of rows in the order of their sizes, folded to the bits of the smaller of two."""

    def __init__(self, packed: list[bytes], order: np.ndarray, words: np.ndarray):
        self.packed, self.order, self.words = packed, order, words
        self.by_words: dict[int, tuple[int, np.ndarray]] = {}

    def of(self, words: int) -> tuple[int, np.ndarray]:
        """The first row that has so many words, and it and all later rows folded to them."""
        if words not in self.by_words:
            first = int(np.searchsorted(self.words, words))
            parts = [np.empty((0, words), np.uint64)]
            for w in np.unique(self.words[first:]).tolist():
                rows = self.order[first:][self.words[first:] == w]
                parts.append(folded(np.frombuffer(b"".join([self.packed[r] for r in rows]), np.uint64).reshape(len(rows), w), words))
            self.by_words[words] = first, np.concatenate(parts)
        return self.by_words[words]

    def differing(self, at: int, others: np.ndarray) -> np.ndarray:
        """The bits in which row ``at`` and each of the later rows ``others`` differ."""
        first, maps = self.of(int(self.words[at]))
        return maps[others - first] ^ maps[at - first]


def ngram_jaccard_join(
    docs: DataFrame,
    stage: Stage,
    n: int = 5,
    threshold: tuple[int, int] = (3, 4),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_shingles, class_id, component_id, group, doc)`` for each row of ``docs``.

    Documents link when intersection / union >= num / den of ``threshold``.
    ``class_id`` is the smallest id with the same set, ``component_id`` the
    smallest id that links lead to, the document included.  ``group`` tells components
    apart whatever their ids (null for empty sets); ``doc`` stands for the row, see
    :func:`~bridgerec.llm.staging.row_key`.
    """
    num, den = threshold
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("row"), text.alias("text"))
    sets = stage.write(_sets(rows.withColumn("doc", row_key("row", "text")), n), "sets")
    levels = _levels(sets)
    sets = sets.filter("sketch is null").drop("sketch").withColumn("class", F.when(F.col("n") > 0, F.col("class")))
    lists = stage.write(_shared(_postings(rows, n, levels, num, den), num, den), "lists")
    members = sets.filter("n > 0").groupBy("class").agg(F.min("id").alias("row"), F.min("n").alias("n"), F.min("bitmap").alias("bitmap"))
    members = stage.write(members, "members")
    light = members.drop("row")
    sets = stage.write(sets.drop("bitmap"), "rows")
    stage.drop("sets")

    star = lists.select("class", F.explode(F.array("before", "first")).alias("to")).filter("class != to")
    star = star.select(F.least("class", "to").alias("a"), F.greatest("class", "to").alias("b")).dropDuplicates()
    links = _verified(_bounded(star, light, num, den), rows, members, stage, "star", n, num, den)
    found = connected_components(links, stage, "cc-star")
    again = None
    for name in ("closest", "closer", "rest"):
        if again is not None and again.isEmpty():
            break
        found = stage.write(found, f"found-{name}")
        rows_of = lists.select("token", "class", "place")
        rows_of = rows_of if again is None else rows_of.join(again, "token", "left_semi")
        labelled = rows_of.join(found.toDF("class", "component"), "class", "left")
        labelled = labelled.withColumn("component", F.coalesce("component", "class"))
        pairs = stage.write(_tiles(labelled, light, num, den, name != "rest"), f"pairs-{name}")
        again = pairs.filter("token is not null").select("token")
        near = _bounded(pairs.filter("token is null").select("a", "b"), light, num, den)
        links = _verified(near, rows, members, stage, name, n, num, den)
        found = merged_components(found, links, stage, f"cc-{name}")

    named = sets.join(found.toDF("class", "linked"), "class", "left")
    named = named.withColumn("linked", F.coalesce("linked", "class"))
    classes = named.filter("class is not null").groupBy("class", "linked").agg(F.min("id").alias("class_id"))
    least = classes.groupBy("linked").agg(F.min("class_id").alias("component_id"))
    names = classes.join(least, "linked").select("class", "class_id", "component_id", F.col("linked").alias("group"))
    return sets.join(names, "class", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("component_id", "id").alias("component_id"),
        "group",
        "doc",
    )


def drop_near_duplicates(
    docs: DataFrame,
    stage: Stage,
    n: int = 5,
    threshold: tuple[int, int] = (3, 4),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with one row of each group of linked documents, the one with the smallest
    id (null ids last); documents without words all stay."""
    found = stage.write(ngram_jaccard_join(docs, stage, n, threshold, id_col, text_col), "joined").filter("group is not null")
    last = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    stay = found.groupBy("group").agg(F.min(F.struct(last.alias("id"), "doc")).alias("one")).select("group", F.col("one.doc").alias("doc"))
    key = fresh_name(docs, "doc_key")
    go = found.select("group", "doc").distinct().join(stay, ["group", "doc"], "left_anti").select(F.col("doc").alias(key))
    twice = found.groupBy("doc").count().filter("count > 1").select(F.col("doc").alias(key))
    kept = docs.withColumn(key, row_key(id_col, text_col)).join(maybe_broadcast(go), key, "left_anti")
    twice = stage.write(twice, "twice")
    if not twice.isEmpty():  # rows that agree in id and text are told apart by nothing: one of them stays
        few = maybe_broadcast(twice)
        one = kept.join(few, key, "left_semi").dropDuplicates([key])
        kept = kept.join(few, key, "left_anti").unionByName(one)
    return kept.drop(key)

"""SimHash near-dedup: fingerprints of word shingles, linked by a self-join of binary tries.

Fingerprints within ``errors`` differing bits agree exactly in some of the blocks that 64 bits are cut into. Each one is
dealt to a trie for every choice of blocks that may agree; a trie lives in one partition and is joined with itself:
node pairs go down together, differing bits add up, and a pair is given up once they exceed the budget. All tries of a
partition are traversed level by level at once, as ranges of a sorted array. Tries that a large group of copies fills
are cut into parts that are joined pairwise, so no task holds more than two parts. A task hands on a spanning forest
of the links it finds, never all pairs; components then come from alternating star contractions on tables.

Near copies by similarity take their first links from the same tries, each confirmed on the whole sets of shingles, and
the rest, which fingerprints can't promise to bring near each other, from shared prefixes of the sets.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftfield.llm.shared import arrow_mapped, byte_sizes, cut, shared_dir, slices, written

SEED = 42
#: Fingerprints of the parts that a full trie is cut into; and of the tries that near copies leave whole.
PART, WHOLE = 1024, 4096
#: Fingerprints that the tries of one partition hold on average.
PER_TASK = 50_000
#: Tables of full tries and cells of up to so many rows (16 bytes each) are broadcast; larger ones are joined by a shuffle.
BROADCAST = 100_000
#: Edges that a task contracts on its own before the rounds over tables.
EDGES_PER_TASK = 200_000
#: Candidates that are looked at together, hashes of sets that are held together, and pairs below the similarity that a task remembers.
PAIRS, HASHES, BELOW = 1 << 16, 1 << 21, 1 << 22
#: Texts whose shingles tell which ones are common, and how many common ones are told apart. Both shorten the work only.
SAMPLE, COMMON = 8192, 200_000
#: Node pairs below which leaves are compared directly.
DIRECT = 64


def bit_counts(rows: np.ndarray) -> np.ndarray:
    """How many of the rows (n x k words of 64 bits) have each bit set.

    Full adders work on whole words: three rows of one weight become a sum row and a carry row of twice the weight, until
    a few rows of each weight are left to unpack.
    """
    counts, weight = np.zeros(64 * rows.shape[1], dtype=np.int64), 0
    while rows.shape[0]:
        carries = [rows[:0]]
        while rows.shape[0] > 2:
            t = rows.shape[0] // 3
            x, y, z = rows[:t], rows[t : 2 * t], rows[2 * t : 3 * t]
            either = x ^ y
            carries.append((x & y) | (either & z))
            rows = np.concatenate([either ^ z, rows[3 * t :]])
        bits = np.unpackbits(np.ascontiguousarray(rows).view(np.uint8).reshape(rows.shape[0], -1), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64) << weight
        rows, weight = np.concatenate(carries), weight + 1
    return counts


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; a text of fewer words is one shingle, one without words has none."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, dtype="<u8")
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([digest(joined, SEED)], dtype="<u8")
    lens = np.fromiter(map(len, words), dtype=np.int64, count=n)
    ends = np.cumsum(lens + 1) - 1
    starts, stops = (ends - lens)[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), dtype="<u8", count=n - shingle + 1)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The hash itself, and k - 1 more that a mixer (splitmix64) makes of it, as columns."""
    out = [h]
    for i in range(1, k):
        x = h + np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ (x >> np.uint64(31)))
    return np.stack(out, axis=1)


def signature(hashes: np.ndarray, k: int = 1) -> np.ndarray:
    """``k`` fingerprints of 64 bits: a bit is one if it is in over half the hashes. Without hashes they are zero."""
    counts, n = np.zeros(64 * k, dtype=np.int64), len(hashes)
    for i in range(0, n, 1 << 14):
        counts += bit_counts(_mixed(hashes[i : i + (1 << 14)], k))
    return np.packbits(2 * counts > n, bitorder="little").view("<u8")


def fingerprint(text: bytes | None, shingle: int) -> int:
    """Majority bits of XXH64 over the shingles of a text."""
    return int(signature(shingle_hashes(text, shingle))[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4, made: str = "fingerprint") -> DataFrame:
    """``docs`` with the 64-bit fingerprint of every whole text as a bigint (two's complement).

    Null, empty and blank texts have fingerprint zero. One row for every input row; an input column called like the
    made one is replaced.
    """

    def make(columns: list[pa.Array]) -> Iterator[tuple[int, int, list[pa.Array]]]:
        for a, b in slices(byte_sizes(columns[0]), 4 << 20):
            marks = np.array([fingerprint(x, shingle) for x in columns[0].slice(a, b - a).to_pylist()], dtype=np.uint64)
            yield a, b, [pa.array(marks.view(np.int64))]

    return arrow_mapped(docs, [text], [T.StructField(made, T.LongType())], make)


def hexed(mark: Column) -> Column:
    return F.lower(F.lpad(F.hex(mark), 16, "0"))


def bounds(blocks: int) -> list[int]:
    return [i * 64 // blocks for i in range(blocks + 1)]


def choices(errors: int, n: int) -> list[tuple[int, int]]:
    """(mask of the blocks that must agree, number) for a cut of 64 bits: more blocks, hence longer keys, for more fingerprints."""
    for agree in range(1, 5):
        blocks = errors + agree
        edges = bounds(blocks)
        masks = [sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen) for chosen in combinations(range(blocks), agree)]
        if n <= PART << min(m.bit_count() for m in masks) or agree == 4:
            return list(zip(masks, range(len(masks))))
    raise AssertionError


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every member of each range, and which range it is of."""
    n = hi - lo
    which = np.repeat(np.arange(n.size), n)
    return np.arange(which.size) - np.repeat(np.cumsum(n) - n, n) + lo[which], which


def trie_links(trie: np.ndarray, mark: np.ndarray, errors: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (positions) of rows in the same trie whose marks differ in at most ``errors`` bits.

    Rows are sorted by (trie, mark).
    """
    n = trie.size
    if n < 2:
        return
    begins = np.flatnonzero(np.concatenate([[True], trie[1:] != trie[:-1]]))
    ends = np.concatenate([begins[1:], [n]])
    big = ends - begins > 1
    alo, ahi = begins[big], ends[big]
    blo, bhi, err = alo.copy(), ahi.copy(), np.zeros(alo.size, dtype=np.int64)
    # A stack of frontiers, each one level of node pairs; large ones are split so that memory stays small.
    stack = [(63, alo, ahi, blo, bhi, err)]
    while stack:
        bit, alo, ahi, blo, bhi, err = stack.pop()
        if not alo.size:
            continue
        if alo.size > 1 << 18:
            h = alo.size // 2
            stack += [(bit, alo[h:], ahi[h:], blo[h:], bhi[h:], err[h:]), (bit, alo[:h], ahi[:h], blo[:h], bhi[:h], err[:h])]
            continue
        work = (ahi - alo) * (bhi - blo)
        leaf = (work <= DIRECT) | (bit < 0)
        if leaf.any():
            # Equal marks can fill a leaf; its rows are taken a few at a time.
            most = np.maximum(1, (1 << 20) // (bhi[leaf] - blo[leaf]))
            nth, of = _ranges(np.zeros(most.size, dtype=np.int64), -((alo[leaf] - ahi[leaf]) // most))
            clo = alo[leaf][of] + nth * most[of]
            chi, dlo, dhi = np.minimum(clo + most[of], ahi[leaf][of]), blo[leaf][of], bhi[leaf][of]
            upto = np.cumsum((chi - clo) * (dhi - dlo))
            cuts = np.searchsorted(upto, np.arange(1 << 20, int(upto[-1]) + (1 << 20), 1 << 20), side="right") + 1
            for part in np.split(np.arange(of.size), np.unique(np.minimum(cuts, of.size))):
                if part.size:
                    left, which = _ranges(clo[part], chi[part])
                    right, again = _ranges(dlo[part][which], dhi[part][which])
                    left = left[again]
                    ok = left < right
                    left, right = left[ok], right[ok]
                    near = np.bitwise_count(mark[left] ^ mark[right]) <= errors
                    if near.any():
                        yield left[near], right[near]
            rest = ~leaf
            alo, ahi, blo, bhi, err = alo[rest], ahi[rest], blo[rest], bhi[rest], err[rest]
            if not alo.size:
                continue
        ones = np.concatenate([[0], np.cumsum((mark >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        one = alo == blo  # a node with itself: its two children meet once
        parts = [(alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err), (alo, amid, bmid, bhi, err + 1), (amid[~one], ahi[~one], blo[~one], bmid[~one], err[~one] + 1)]
        kept = [[x[(p[0] < p[1]) & (p[2] < p[3]) & (p[4] <= errors)] for x in p] for p in parts]
        stack.append((bit - 1, *[np.concatenate([p[i] for p in kept]) for i in range(5)]))


class Forest:
    """Union-find over positions, a batch of links at a time."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up


def _read(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
    """The partition's columns, sorted by (trie, mark)."""
    parts = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
    if not parts:
        return None
    trie, mark, *more = (np.concatenate(x) for x in zip(*parts))
    mark = mark.view(np.uint64)
    order = np.lexsort((mark, trie))
    return [x[order] for x in (trie, mark, *more)]


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _forest_links(errors: int):
    """Of the links in a partition a spanning forest, between fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := _read(batches)) is None:
            return
        trie, mark = got[:2]
        forest = Forest(trie.size)
        for a, b in trie_links(trie, mark, errors):
            forest.join(a, b)
        tied = np.flatnonzero(forest.root != np.arange(trie.size))
        yield _edges(mark[tied].view(np.int64), mark[forest.root[tied]].view(np.int64))

    return run


class Sets:
    """Sorted sets of hashes in files of the shared folder, read by place.

    A place is the partition, batch and first word of a set, so places follow the order of rows. A task that is run again
    writes the same files, as its rows come in the same order.
    """

    def __init__(self, spark):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/sets-{uuid.uuid4().hex}")
        uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
        self.uri = f"file://{uri.getPath()}" if uri.getScheme() == "file" else uri.toString()
        self.open, self.at = {}, None

    def __getstate__(self):
        return {"uri": self.uri, "open": {}, "at": None}

    def _folder(self):
        from pyarrow import fs

        if self.at is None:
            self.at = fs.FileSystem.from_uri(self.uri)
        return self.at

    def write(self, partition: int, batch: int, sets: list[np.ndarray]) -> np.ndarray:
        """Places of the sets of one batch."""
        folder, path = self._folder()
        sizes = np.array([max(1, x.size) for x in sets], dtype=np.int64)  # an empty set takes a word: each place is of one row
        if partition >= 1 << 22 or batch >= 1 << 15 or sizes.sum() >= 1 << 26:
            raise ValueError("too many partitions, batches or words for a place")
        folder.create_dir(path, recursive=True)
        name = f"{path}/{partition}-{batch}"
        with folder.open_output_stream(own := f"{name}.{uuid.uuid4().hex}") as out:
            out.write(np.concatenate([x if x.size else np.zeros(1, dtype="<u8") for x in sets]).tobytes())
        folder.move(own, name)
        return (partition << 41) + (batch << 26) + np.cumsum(sizes) - sizes

    def read(self, place: int, size: int) -> np.ndarray:
        if (file := self.open.get(place >> 26)) is None:
            if len(self.open) >= 256:
                self.open.pop(next(iter(self.open))).close()
            folder, path = self._folder()
            file = self.open[place >> 26] = folder.open_input_file(f"{path}/{place >> 41}-{place >> 26 & 0x7FFF}")
        return np.frombuffer(file.read_at(8 * size, 8 * (place & 0x3FFFFFF)), dtype="<u8")


def prefix_size(n: int, similarity: float) -> int:
    """How many first elements of a set of ``n``, in an order that all sets share, two similar sets can't both have apart."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def common_hashes(sets: Sets, nodes: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that several texts of a sample share, sorted, and in how many they are."""
    some = nodes.where(F.pmod(F.xxhash64("node"), F.lit(max(1, n // SAMPLE))) == 0).select("node", "size").toPandas() if n else None
    if some is None or not len(some):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    parts, held = [], 0
    for place, size in zip(some["node"].tolist(), some["size"].tolist()):
        parts.append(sets.read(place, size))
        if (held := held + size) > 2 * HASHES:
            break
    hashes, times = np.unique(np.concatenate(parts), return_counts=True)
    hashes, times = hashes[times > 2], times[times > 2]
    most = np.sort(np.argsort(-times, kind="stable")[:COMMON])
    return hashes[most], times[most]


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first elements of a sorted set in the order of all sets: those not known as common, then rarer ones first."""
    k = prefix_size(hashes.size, similarity)
    if common.size and hashes.size:
        at = np.minimum(np.searchsorted(common, hashes), common.size - 1)
        rank = np.where(common[at] == hashes, times[at], 0)
        if rank.any():
            return hashes[np.lexsort((hashes, rank))[:k]]
    return hashes[:k]


def similar(sets: Sets, node: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs (positions, sorted by the first) have sets of that Jaccard similarity, counted on the whole sets."""
    used = np.unique(np.concatenate([a, b]))
    if a.size > 1 and size[used].sum() > HASHES:
        h = a.size // 2
        return np.concatenate([similar(sets, node, size, a[:h], b[:h], similarity), similar(sets, node, size, a[h:], b[h:], similarity)])
    sizes = size[used]
    _, ids = np.unique(np.concatenate([sets.read(p, n) for p, n in zip(node[used].tolist(), sizes.tolist())]), return_inverse=True)
    ends = np.cumsum(sizes)
    begins, flag = ends - sizes, np.zeros(int(ids.max()) + 1, dtype=bool)
    x, y = np.searchsorted(used, a), np.searchsorted(used, b)
    same = np.zeros(a.size, dtype=np.int64)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), x.size]):
        own = ids[begins[x[lo]] : ends[x[lo]]]
        flag[own] = True
        for i in range(lo, hi, 4096):
            other = y[i : min(hi, i + 4096)]
            if other.size == 1:
                same[i] = np.count_nonzero(flag[ids[begins[other[0]] : ends[other[0]]]])
            else:
                members, _ = _ranges(begins[other], ends[other])
                same[i : i + other.size] = np.add.reduceat(flag[ids[members]], np.cumsum(sizes[other]) - sizes[other], dtype=np.int64)
        flag[own] = False
    return same >= similarity * (sizes[x] + sizes[y] - same)


class Compared:
    """Pairs of nodes (positions) compared on their whole sets, unless links that were confirmed before connect them already."""

    def __init__(self, sets: Sets, node: np.ndarray, size: np.ndarray, similarity: float):
        self.sets, self.node, self.size, self.similarity = sets, node, size, similarity
        self.forest, self.below = Forest(node.size), np.zeros(0, dtype=np.int64)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for i in range(0, a.size, PAIRS):
            x, y = a[i : i + PAIRS], b[i : i + PAIRS]
            apart = self.forest.root[x] != self.forest.root[y]
            pairs = np.unique(np.minimum(x, y)[apart] * self.node.size + np.maximum(x, y)[apart])
            pairs = pairs[~np.isin(pairs, self.below, assume_unique=True)]
            if not pairs.size:
                continue
            x, y = pairs // self.node.size, pairs % self.node.size
            near = similar(self.sets, self.node, self.size, x, y, self.similarity)
            self.forest.join(x[near], y[near])
            self.below = np.concatenate([self.below if self.below.size < BELOW else self.below[:0], pairs[~near]])


def _confirmed_links(sets: Sets, similarity: float):
    """Of the pairs whose fingerprints differ in few bits and whose sets are similar a spanning forest, between nodes."""

    def within(errors: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if (got := _read(batches)) is None:
                return
            trie, mark, place, size = got
            node, first, at = np.unique(place, return_index=True, return_inverse=True)
            compared = Compared(sets, node, size[first], similarity)
            for a, b in trie_links(trie, mark, errors):
                compared.add(at[a], at[b])
            root = compared.forest.root
            tied = np.flatnonzero(root != np.arange(node.size))
            yield _edges(node[tied], node[root[tied]])

        return run

    return within


def _similar_links(sets: Sets, similarity: float):
    """Of the pairs that share a hash of their prefixes and are similar a spanning forest, between nodes.

    Every pair whose sizes and places of the hash allow the similarity is compared, unless links that were confirmed
    before connect it already: those of the task, and those of the fingerprints, which have given their nodes a group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := _read(batches)) is None:
            return
        trie, mark, place, group = got
        more = trie[1:] == trie[:-1]
        shared = np.concatenate([more, [False]]) | np.concatenate([[False], more])
        trie, mark, place, group = trie[shared], mark[shared].view(np.int64), place[shared], group[shared]
        if not trie.size:
            return
        n, rest = mark >> 24, (mark >> 24) - (mark & 0xFFFFFF)
        node, first, at = np.unique(place, return_index=True, return_inverse=True)
        compared = Compared(sets, node, n[first], similarity)
        tied = np.flatnonzero(group[first] >= 0)
        _, least, of = np.unique(group[first][tied], return_index=True, return_inverse=True)
        compared.forest.join(tied, tied[least][of])
        given = compared.forest.root.copy()
        begins = np.flatnonzero(np.concatenate([[True], trie[1:] != trie[:-1]]))
        ends = np.concatenate([begins[1:], [trie.size]])
        list_of = np.repeat(np.arange(begins.size), ends - begins)
        # Rows of a hash are sorted by size: partners of a row follow it up to the largest size that can be similar.
        key = list_of.astype(np.float64) * (step := float(n.max() + 2)) + n
        upto = np.searchsorted(key, list_of * step + np.minimum(n / similarity + 1e-6, step - 1), side="right")
        partners = np.maximum(upto - np.arange(trie.size) - 1, 0)
        total, row = np.cumsum(partners), 0
        while row < trie.size:
            until = max(row + 1, int(np.searchsorted(total, (total[row - 1] if row else 0) + PAIRS, side="right")))
            left = np.arange(row, until)
            row = until
            right, which = _ranges(left + 1, left + 1 + partners[left])
            left = left[which]
            # A similar pair is found at the first hash that both have, after which enough must be left.
            ok = np.minimum(rest[left], rest[right]) >= similarity / (1 + similarity) * (n[left] + n[right]) - 1e-6
            compared.add(at[left[ok]], at[right[ok]])
        root = compared.forest.root
        tied = np.flatnonzero((given == np.arange(node.size)) & (root != given))
        yield _edges(node[tied], node[root[tied]])

    return run


def _full_tries(dealt: DataFrame, rows: int, most: int) -> DataFrame:
    """``trie``, ``parts`` of the tries with more than ``most`` rows.

    Rows are first counted in coarse cells of tries, of which each task hands on few; only tries in cells that hold more
    than ``most`` rows are counted one by one.
    """
    cell = F.pmod(F.xxhash64(F.lit("cell"), "trie"), F.lit(max(1, 8 * rows // most)))
    cells = cut(dealt.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).where(F.col("n") > most).select("cell"))
    cells = F.broadcast(cells) if cells.count() <= BROADCAST else cells
    near = dealt.withColumn("cell", cell).join(cells, "cell", "left_semi")
    full = cut(near.groupBy("trie").agg(F.count("*").alias("n")).where(F.col("n") > most).select("trie", F.ceil(F.col("n") / PART).cast("int").alias("parts")))
    return F.broadcast(full) if full.count() <= BROADCAST else full


def _dealt(marks: DataFrame, masks: list[tuple[int, int]], errors: int, run, columns: list[str], rows: int, most: int) -> DataFrame:
    """Deals (``mark``, ``sketch``, ...) to tries and runs the self-join in each partition.

    Tries of more than ``most`` rows are cut: a row goes to the part that a hash names, and each pair of parts is a trie.
    """
    mark = F.col("mark")
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.array(*[F.xxhash64(F.lit(i), "sketch", mark.bitwiseAND(F.lit(signed(m)).cast("long"))) for m, i in masks])
    return _joined(marks.select(*columns, F.explode(keys).alias("trie")), run(errors), columns, rows * len(masks), most)


def _joined(dealt: DataFrame, run, columns: list[str], rows: int, most: int) -> DataFrame:
    """Runs the self-join of the tries in each partition; full ones are cut, and each pair of parts is a trie."""
    full = _full_tries(dealt, rows, most)
    parts, own = F.coalesce("parts", F.lit(1)), F.pmod(F.xxhash64(F.lit("part"), *columns), F.coalesce("parts", F.lit(1)))
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda x: F.xxhash64("trie", F.least(own, x.cast("long")), F.greatest(own, x.cast("long"))))
    each = dealt.join(full, "trie", "left").select(F.when(parts == 1, F.array("trie")).otherwise(pairs).alias("tries"), *columns).select(F.explode("tries").alias("trie"), *columns)
    tasks = max(1, math.ceil(rows / PER_TASK), int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return each.repartition(tasks, "trie").mapInArrow(run, "a long, b long").distinct()


def links(marks: DataFrame, errors: int = 4, column: str = "fingerprint") -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints: a forest that connects what pairs within ``errors`` bits connect.

    ``marks`` has each fingerprint once. Every pair is compared in some trie; no pair is lost to a cap.
    """
    n = marks.count()
    return _dealt(marks.select(F.col(column).alias("mark"), F.lit(0).alias("sketch")), choices(errors, n), errors, _forest_links, ["mark"], n, PART)


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars: each node with the smallest one that the task's own edges reach."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if parts:
        u, v = (np.concatenate(x) for x in zip(*parts))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        forest = Forest(nodes.size)
        forest.join(at[: u.size], at[u.size :])
        tied = np.flatnonzero(forest.root != np.arange(nodes.size))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[forest.root[tied]])], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node reachable) for every node of ``a``-``b`` edges, by alternating star contractions.

    Each task first contracts its own edges; what is left is a few rounds. A round replaces the edges: large stars tie greater neighbours, small stars smaller ones, to the smallest. Both are
    a grouped minimum and a join, so that a node with a third of all edges is pre-aggregated and its join can be split.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    edges = cut(edges.coalesce(max(1, edges.count() // EDGES_PER_TASK)).mapInArrow(_contracted, "u long, v long"))
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        edges = cut(small.distinct())
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())


def classes(marked: DataFrame, doc_id: str = "doc_id", column: str = "fingerprint", errors: int = 4) -> DataFrame:
    """``column``, ``component_id``: for each distinct fingerprint the smallest ``doc_id`` of its component (null if it has no other)."""
    marks = cut(marked.groupBy(F.col(f"`{column}`").alias("mark")).agg(F.min(F.col(f"`{doc_id}`")).alias("least")))
    roots = components(links(marks.select(F.col("mark").alias(column)), errors, column))
    tied = marks.join(roots, F.col("mark") == F.col("node"))
    least = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    tied = tied.join(least, "root").select(F.col("mark").alias("m"), "component_id")
    return marks.join(tied, F.col("mark") == F.col("m"), "left").select(F.col("mark").alias(column), F.when(F.col("m").isNotNull(), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, errors: int = 4) -> DataFrame:
    """One row per input row: ``doc_id``, ``fingerprint`` and ``component_id``, the smallest ``doc_id`` reachable over links.

    Rows with equal fingerprints are linked, as are those that differ in ``errors`` bits at most; null, empty and blank
    texts have fingerprint zero and are linked like any other. Repeated rows keep a row each. A null ``doc_id`` is
    smaller than none: it names a component only if no other id does. An empty table gives an empty result.
    """
    marked = cut(fingerprints(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", shingle).drop("text"))
    return marked.join(cut(classes(marked, errors=errors)), "fingerprint").select("doc_id", "fingerprint", "component_id")


def near_copies(docs: DataFrame, text: str = "text", shingle: int = 5, similarity: float = 0.8, errors: int = 4) -> DataFrame:
    """The documents that stay when one of each group of near copies does: ``docs`` with its columns as they are.

    Texts are near copies if the sets of their word shingles have a Jaccard similarity of ``similarity`` or more; texts of
    the same words are copies (those without words, too). Fingerprints within ``errors`` bits, found by the self-join of
    tries, are the first candidates. What fingerprints miss comes by prefix filtering: in an order of all shingles, similar
    sets share one of their first few, so no pair is lost. Each candidate is compared exactly, unless confirmed links
    connect it already; groups are what confirmed links connect, and the first document of a group stays. Null texts count
    as empty; an empty table gives an empty result.
    """
    columns, sets = docs.columns, Sets(docs.sparkSession)
    made = [T.StructField("__words", T.StringType()), T.StructField("__node", T.LongType()), T.StructField("__size", T.LongType()), T.StructField("__mark", T.LongType())]
    batches = iter(range(1 << 62))

    def make(batch: list[pa.Array]) -> Iterator[tuple[int, int, list[pa.Array]]]:
        partition = TaskContext.get().partitionId()
        for a, b in slices(byte_sizes(batch[0]), 4 << 20):
            texts = [x or b"" for x in batch[0].slice(a, b - a).to_pylist()]
            hashes = [shingle_hashes(x, shingle) for x in texts]
            marks = np.array([signature(x)[0] for x in hashes], dtype=np.uint64)
            each = [np.unique(x) for x in hashes]
            words = [xxhash.xxh3_128_hexdigest(b" ".join(x.lower().split())) for x in texts]
            yield a, b, [pa.array(words, pa.string()), pa.array(sets.write(partition, next(batches), each)), pa.array([x.size for x in each], pa.int64()), pa.array(marks.view(np.int64))]

    rest = [c for c in columns if c != text]
    source = docs.select(F.struct(*[docs[f"`{c}`"] for c in rest], F.lit(0).alias("__none")).alias("__rest"), F.col(f"`{text}`").cast("string").alias("__text"))
    kept = written(arrow_mapped(source, ["__text"], made, make), "sets")
    nodes = cut(kept.groupBy("__words").agg(F.min(F.struct("__node", "__size", "__mark")).alias("m")).select(F.col("m.__node").alias("node"), F.col("m.__size").alias("size"), F.col("m.__mark").alias("mark")))
    n, hashes = nodes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    marks = nodes.where("size > 0").select("mark", F.lit(0).alias("sketch"), "node", "size")
    linked = cut(components(_dealt(marks, choices(errors, n), errors, _confirmed_links(sets, similarity), ["mark", "node", "size"], n, PART)).select(F.col("node").alias("a"), F.col("root").alias("b")))
    common = docs.sparkSession.sparkContext.broadcast(common_hashes(sets, nodes, n))

    def dealt(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            place, size, group = (c.to_numpy() for c in batch.columns)
            for a, b in slices(8 * size, 8 * HASHES):
                firsts = [prefix(sets.read(p, k), similarity, *common.value) for p, k in zip(place[a:b].tolist(), size[a:b].tolist())]
                lens = np.array([x.size for x in firsts], dtype=np.int64)
                at, which = _ranges(np.zeros(lens.size, dtype=np.int64), lens)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in ((size[a:b][which] << 24) + at, place[a:b][which], group[a:b][which], np.concatenate(firsts).view(np.int64))], names=["mark", "node", "group", "trie"])

    grouped = nodes.where("size > 0").join(linked, F.col("node") == F.col("a"), "left").select("node", "size", F.coalesce("b", F.lit(-1)).alias("group"))
    each = grouped.mapInArrow(dealt, "mark long, node long, group long, trie long")
    near = _joined(each, _similar_links(sets, similarity), ["mark", "node", "group"], n + round((1 - similarity) * int(hashes)), WHOLE)
    gone = components(near.union(linked)).where("node <> root").select(F.col("node").alias("__gone"))
    stay = nodes.join(gone, nodes["node"] == gone["__gone"], "left_anti").select("node")
    return kept.join(stay, kept["__node"] == stay["node"], "left_semi").select(*[F.col("__text" if c == text else f"__rest.`{c}`").alias(c) for c in columns])

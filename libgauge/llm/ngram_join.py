"""Jaccard join of documents on word n-grams, by T-occurrence search.

A document's set holds its distinct shingles of ``n`` words (A-Z lower-cased; words are runs of
other bytes than ASCII white space; a text of fewer words is one shingle).  Two documents link when
100 * intersection >= percent * union; components of links come out.

A partner has at least T(a) = ceil(percent * |a| / 100) of a's shingles.  That one bound carries each
step, and no step drops a pair it can't exclude:

1. Which shingles are alone.  Hashes below a share of the hash range (all of them in small sets) are
   sorted, one bucket at a time.  A set with more than |a| - T(a) shingles that nobody else has
   links with nothing and leaves.
2. T-occurrence search.  What remains is dealt by its least hash, at most DEAL sets and DEAL_BYTES to a task of one
   hash; equal sets count once.  Each deal's sets are searched in blocks of BLOCK against inverted indexes
   of the deal's earlier blocks and their own, by DivideSkip: the short inverted lists are merged,
   the long ones probed by binary search for those sets that may still reach T.
3. Links across deals.  Sets that link share one of their |a| - T(a) + 1 least hashes.  The lists of those
   hashes that hold more than one component so far are compared, lists of the same members once: pairs that their sizes and the parity
   of their hashes (a lower bound of the symmetric difference, from sketches as wide as large sets
   need) don't exclude are counted exactly; first a spanning forest of them, then all that still join
   different components.  Only sets outside a list's largest component are compared with the rest; a
   long list is split into blocks over many tasks.
4. Components by label propagation over tables in the shared folder.

Hashes have 64 bits (40 in step 1, where a false tie only delays a set).

Defined results: a null or empty text or one of white space has the empty set, links with nothing
and is its own component; repeated rows link with each other; a component whose ids are all null has
a null id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Workspace, bounded_batches, fresh, row_marks, rows_out
from .suffix_dedup import BUCKET_BYTES, BUCKETS, DEALT, DEALT_DDL, SAMPLE_BITS, Rolling, chunk_table, deal, distinct_sorted, pack_sorted, tied, unpack_sorted, untangle

WORDS, PERCENT = 3, 90
#: Sets of at most so many shingles are dealt out whole in step 1.
SMALL_SET = 64
#: So many sets are indexed at a time in step 2; a task gets so many of one least hash.
BLOCK, DEAL = 1024, 4096
#: And so many bytes of hashes: a task holds those of its deal.
DEAL_BYTES = 64 << 20
#: Lists of step 3 with more members than this are split into blocks.
LIST = 1024
SKETCH_BITS = 1024
#: Bits of the second sketch of sets with more than WIDE_SET shingles.
WIDE_BITS, WIDE_SET = 1 << 13, 512
#: Tables of at most so many rows (of 8 or 16 bytes) are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD_HASH = Rolling(31)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_sets(data: np.ndarray, words: int) -> np.ndarray:
    """The distinct shingle hashes of one text, ascending."""
    space = SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    WORD_HASH._powers(1 << max(16, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(WORD_HASH.value[LOWER[data]] * WORD_HASH.up[: len(data)], out=sums[1:])
    word = mix((sums[ends] - sums[starts]) * WORD_HASH.down[starts])
    size = min(words, len(word))
    n = len(word) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + word[k : k + n])
    return distinct_sorted(h)


def needed(n, percent: int):
    """T: how many of its n shingles a partner has at least."""
    return -(-percent * n // 100)


def share(n: int, percent: int) -> float:
    """Which part of the hash range a set of n shingles asks about; it never grows with n."""
    return min(1.0, max(0.1 + 1.8 * (100 - percent) / 100, SMALL_SET / max(1, n)))


def below(values: np.ndarray, part: float) -> np.ndarray:
    return values if part >= 1 else values[: np.searchsorted(values, np.uint64(int(part * 2.0**63)) * np.uint64(2))]


def parity(values: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """Parity of the hashes in classes: sketches differ in no more bits than sets in elements."""
    return np.packbits(np.bincount((values >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1).tobytes()


def within(far, sizes, percent: int):
    """Can sets of together ``sizes`` elements link if they differ in at least ``far``?"""
    return (100 + percent) * far <= (100 - percent) * sizes


def links(common: int, a: int, b: int, percent: int) -> bool:
    return a > 0 and b > 0 and 100 * common >= percent * (a + b - common)


class Roots:
    """Union-find; the least member is the root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while self.up.get(root, root) != root:
            root = self.up[root]
        while self.up.get(x, x) != root:
            self.up[x], x = root, self.up[x]
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


class DivideSkip:
    """An inverted index over sets that answers T-occurrence queries."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.tokens, token = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        self.lists = owner[np.argsort(token, kind="stable")]
        self.ends = np.cumsum(np.bincount(token, minlength=len(self.tokens)))
        self.starts = self.ends - np.bincount(token, minlength=len(self.tokens))

    def search(self, query: np.ndarray, least: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets before ``upto`` with at least ``least`` of the query's tokens, and how many they have."""
        at = np.searchsorted(self.tokens, query)
        at = at[self.tokens[np.minimum(at, len(self.tokens) - 1)] == query]
        length = self.ends[at] - self.starts[at]
        order = at[np.argsort(length, kind="stable")]
        longest = int(length.max(initial=1))
        n_long = min(max(0, least - 1), int(least / (0.0085 * np.log2(longest + 1) + 1))) if longest > 8 else 0
        short, long = order[: len(order) - n_long], order[len(order) - n_long :]
        sizes = self.ends[short] - self.starts[short]
        if not sizes.sum():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        merged = np.sort(self.lists[np.repeat(self.starts[short], sizes) + within], kind="stable")  # merges ascending runs
        edge = np.flatnonzero(np.r_[True, merged[1:] != merged[:-1], True])
        found, total = merged[edge[:-1]], np.diff(edge)
        fits = (total >= max(1, least - len(long))) & (found < upto)
        found, total = found[fits], total[fits]
        for k, t in enumerate(long):
            if not len(found):
                break
            members = self.lists[self.starts[t] : self.ends[t]]
            place = np.searchsorted(members, found)
            total = total + (members[np.minimum(place, len(members) - 1)] == found)
            alive = total + (len(long) - 1 - k) >= least
            found, total = found[alive], total[alive]
        return found, total


class Deal:
    """The sets of one least hash, searched block by block against all that came before."""

    def __init__(self, percent: int):
        self.percent, self.roots = percent, Roots()
        self.blocks: list[tuple[list[int], DivideSkip]] = []

    def link(self, nodes: list[int], sets: list[np.ndarray]) -> None:
        own = DivideSkip(sets)
        for q, s in enumerate(sets):
            least = int(needed(len(s), self.percent))
            for members, index in [*self.blocks, (nodes, own)]:
                for c, common in zip(*index.search(s, least, q if index is own else len(members))):
                    if links(int(common), len(s), int(index.sizes[c]), self.percent):
                        self.roots.join(nodes[q], members[c])
        self.blocks.append((nodes, own))


SETS = pa.schema([("node", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("print", pa.binary()), ("shingles", pa.binary())])
SETS_DDL = "node long, doc_id long, n long, key long, print binary, shingles binary"
FIRST = pa.schema([("node", pa.int64()), ("print", pa.binary()), ("root", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("wide", pa.binary()), ("prefix", pa.list_(pa.int64()))])
FIRST_DDL = "node long, print binary, root long, n long, sketch binary, wide binary, prefix array<long>"
PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _texts(r: dict) -> Iterator[np.ndarray]:
    data, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["data"]), np.uint8), 0
    for n in r["lengths"]:
        yield data[at : at + n]
        at += n


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def find_sets(chunks: DataFrame, work: Workspace, words: int, percent: int, buckets: int = BUCKETS) -> DataFrame:
    """All documents with their set's size; those that may link also with their hashes."""

    def asked(values: np.ndarray) -> np.ndarray:
        return below(values, share(percent * len(values) // 100, percent)) >> np.uint64(64 - SAMPLE_BITS)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for r in _rows(batches):
                sent = np.concatenate([np.zeros(0, np.uint64), *(asked(shingle_sets(t, words)) for t in _texts(r))])
                for bucket, values in deal(distinct_sorted(sent), buckets, SAMPLE_BITS):
                    yield bucket, r["chunk"], 0, pack_sorted(values)

        yield from rows_out(DEALT, rows(), size=lambda r: len(r[3]))

    replies = work.save(tied(chunks.select("chunk", "lengths", "data").mapInArrow(dealt, DEALT_DDL)), "shared")
    told = chunks.select("chunk", "ids", "lengths", "data").join(replies.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("bits")).hint("shuffle_hash"), "chunk", "left")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for r in _rows(batches):
                sets = [shingle_sets(t, words) for t in _texts(r)]
                values, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(asked, sets)]), return_counts=True)
                values = values[(counts > 1) | untangle(values, {x["bucket"]: x["bits"] for x in r["bits"] or ()}, buckets, SAMPLE_BITS)]
                values = np.append(values, np.uint64(1 << 63))  # above all hashes, so that every search ends inside
                shared = lambda own: int((values[np.searchsorted(values, own)] == own).sum())  # noqa: E731, B023
                seen = set()
                for place, (doc_id, s) in enumerate(zip(r["ids"], sets)):
                    n, node = len(s), r["chunk"] << 20 | place
                    own = below(s, share(n, percent)) >> np.uint64(64 - SAMPLE_BITS)
                    if not n or len(own) - shared(own) > n - needed(n, percent):
                        yield node, doc_id, n, None, None, None
                        continue
                    mark = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    yield node, doc_id, n, int(s[:1].view(np.int64)[0]), mark, None if mark in seen else pack_sorted(s)
                    seen.add(mark)

        yield from rows_out(SETS, rows(), size=lambda r: len(r[5] or b""))

    return work.save(told.mapInArrow(kept, SETS_DDL), "sets")


def first_links(sets: DataFrame, work: Workspace, percent: int, tasks: int, deal: int = DEAL, deal_bytes: int = DEAL_BYTES) -> DataFrame:
    """Step 2: distinct sets with the root that the search inside their deal gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            key, last, now = None, None, Deal(percent)
            nodes, sets, prints, held = [], [], [], []

            def search():
                if sets:
                    now.link(list(nodes), list(sets))
                    for node, mark, s in zip(nodes, prints, sets):
                        n = len(s)
                        held.append((node, mark, n, parity(s), parity(s, WIDE_BITS) if n > WIDE_SET else None, s[: n - needed(n, percent) + 1].view(np.int64).tolist()))
                for x in (nodes, sets, prints):
                    x.clear()

            def finish():
                search()
                done = [(node, mark, now.roots.find(node), *rest) for node, mark, *rest in held]
                held.clear()
                return done

            for r in _rows(batches):
                if (r["key"], r["part"]) != key:
                    yield from finish()
                    key, last, now = (r["key"], r["part"]), None, Deal(percent)
                if r["print"] == last:
                    continue
                last = r["print"]
                nodes.append(r["node"])
                prints.append(last)
                sets.append(unpack_sorted(r["shingles"]))
                if len(sets) >= BLOCK:
                    search()
            yield from finish()

        yield from rows_out(FIRST, rows(), size=lambda r: 1200 + 9 * len(r[6]))

    whole = sets.filter(F.col("shingles").isNotNull()).select("node", "key", "print", "n", "shingles")
    sizes = whole.groupBy("key").agg(F.count(F.lit(1)).alias("size"), (F.lit(8) * F.sum("n")).alias("bytes"))
    crowded = sizes.select("key", F.greatest(F.ceil(F.col("size") / deal), F.ceil(F.col("bytes") / deal_bytes)).alias("parts")).filter("parts > 1")
    crowded = work.save(crowded, "crowded")
    dealt = whole.join(checked(crowded, crowded.count()), "key", "left").withColumn("part", F.pmod(F.xxhash64("print"), F.coalesce("parts", F.lit(1))))
    return dealt.select("node", "key", "part", "print", "shingles").repartition(tasks, "key", "part").sortWithinPartitions("key", "part", "print", "node").mapInArrow(run, FIRST_DDL)


def open_pairs(lists: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Step 3: pairs of sets of different components that share a least hash and may link.

    ``lists`` has (token, block, major, home, node, root, n, sketch, wide).  Members outside the list's largest
    component (not major) are compared with its members in each block, and with each other in their home
    block.  With ``forest`` only pairs come out that join components not joined by an earlier pair.
    """

    def compare(group: list[tuple]) -> Iterator[tuple]:
        node, root, n = (np.array([g[k] for g in group], np.int64) for k in (0, 1, 2))
        major, home = (np.array([g[k] for g in group], bool) for k in (3, 4))
        sketch = np.frombuffer(b"".join(g[5] for g in group), np.uint64).reshape(len(group), -1)
        wide = [None if g[6] is None else np.frombuffer(g[6], np.uint64) for g in group]
        roots = Roots()
        for k in np.flatnonzero(~major):
            # the least size that may link, and the greatest; groups are sorted by size
            lo, hi = np.searchsorted(n, -(-n[k] * percent // 100), "left"), np.searchsorted(n, n[k] * 100 // percent, "right")
            far = np.bitwise_count(sketch[lo:hi] ^ sketch[k]).sum(1, dtype=np.int64)
            other = root[lo:hi] != root[k]
            other &= major[lo:hi] | home[k]
            near = np.flatnonzero(within(far, n[lo:hi] + n[k], percent) & other)
            for x in near[np.argsort(far[near], kind="stable")] + lo:
                if wide[k] is not None and wide[x] is not None and not within(int(np.bitwise_count(wide[k] ^ wide[x]).sum(dtype=np.int64)), int(n[k] + n[x]), percent):
                    continue
                if not forest or roots.join(int(root[k]), int(root[x])):
                    yield (int(min(node[k], node[x])), int(max(node[k], node[x])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            key, group, seen = None, [], set()

            def close():
                if len(group) > 1 and len({g[1] for g in group}) > 1:
                    for pair in compare(group):
                        if pair not in seen:
                            if len(seen) > 1 << 20:
                                seen.clear()
                            seen.add(pair)
                            yield pair
                group.clear()

            for b in batches:
                for t, block, *row in zip(*(b.column(c).to_pylist() for c in LISTS)):
                    if (t, block) != key:
                        yield from close()
                        key = (t, block)
                    group.append(tuple(row))
            yield from close()

        yield from rows_out(PAIR, rows())

    return lists.select(*LISTS).repartition("token", "block").sortWithinPartitions("token", "block", "n", "node").mapInArrow(run, "a long, b long").distinct()


LISTS = ("token", "block", "node", "root", "n", "major", "home", "sketch", "wide")


def checked(small: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table whose counted rows are within BROADCAST_ROWS; leave a larger one to a shuffle."""
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


def _beside(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """Pairs with columns of a table of nodes, once for a and once for b."""
    for end in "ab":
        pairs = pairs.join(table.select(F.col("node").alias(end), *(F.col(c).alias(c + end) for c in columns)), end)
    return pairs


def count_pairs(pairs: DataFrame, sets: DataFrame, work: Workspace, name: str, percent: int) -> DataFrame:
    """The pairs that link, by their exact intersection."""
    n = pairs.count()
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    used = work.save(sets.filter(F.col("shingles").isNotNull()).select("node", "shingles").join(checked(wanted, 2 * n), "node", "left_semi"), f"{name}_sets")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("shinglesa").to_pylist(), b.column("shinglesb").to_pylist()):
                x, y = unpack_sorted(x), unpack_sorted(y)
                keep.append(links(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return work.save(_beside(pairs, used, "shingles").select("a", "b", "shinglesa", "shinglesb").mapInArrow(count, "a long, b long"), name)


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, label): the least node reachable, for nodes that have edges, by label propagation with
    pointer jumping; each round is a table."""
    both = work.save(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct(), f"{name}_edges")
    now = work.save(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.min("x")).alias("label")), f"{name}_0")
    k = 0
    while True:
        k += 1
        spread = both.join(now, both["y"] == now["node"]).groupBy(F.col("x").alias("node")).agg(F.min("label").alias("offer"))
        step = now.join(spread, "node").select("node", "label", F.least("label", "offer").alias("next"))
        hop = step.select(F.col("node").alias("next"), F.col("next").alias("hop"))
        new = work.save(step.join(hop, "next").select("node", "label", F.least("next", "hop").alias("next")), f"{name}_{k}")
        if new.filter("next != label").limit(1).count() == 0:
            return new.select("node", F.col("next").alias("label"))
        now = new.select("node", F.col("next").alias("label"))
        if k > 1:
            work.drop(f"{name}_{k - 2}")


def relabel(first: DataFrame, edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """New roots after edges between sets."""
    ends = edges.join(first.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(first.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
    moved = components(ends.filter("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")), work, name)
    return work.save(first.join(moved.select(F.col("node").alias("root"), "label"), "root", "left").select("node", "print", F.coalesce("label", "root").alias("root"), "n", "sketch", "wide", "prefix"), f"{name}_first")


def shared_lists(first: DataFrame) -> DataFrame:
    """token, node, root of the lists of step 3 that hold more than one component.  All lists are shuffled once, for
    this; what comes out is saved, so that their shuffle needn't stay while the members are dealt to be compared.
    Lists with the same members, of which a common passage makes many, are one: its token is a hash of the members (lists
    whose hashes clash are compared as one, so no pair is lost)."""
    lists = first.select("node", "root", F.explode("prefix").alias("token"))
    token = Window.partitionBy("token")
    return lists.withColumns({"least": F.min("root").over(token), "most": F.max("root").over(token), "members": F.bit_xor(F.xxhash64("node")).over(token)}).filter("least != most").select(F.col("members").alias("token"), "node", "root").distinct()


def mixed_lists(lists: DataFrame, first: DataFrame, longest: int = LIST) -> DataFrame:
    """The members of such lists with the blocks in which they are compared: one of them for a member of the largest
    component, all of them for the others."""
    parts = lists.groupBy("token", "root").agg(F.count(F.lit(1)).alias("size"))
    mixed = parts.groupBy("token").agg(F.sum("size").alias("size"), F.max(F.struct("size", "root")).alias("most"))
    mixed = mixed.select("token", F.col("most.root").alias("most"), F.ceil(F.col("size") / longest).alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    placed = lists.join(mixed, "token").withColumn("major", F.col("root") == F.col("most")).withColumn("own", own)
    spread = placed.withColumn("block", F.explode(F.when(F.col("major") | (F.col("blocks") == 1), F.array("own")).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))))
    return spread.select("token", "block", "node", "root", "major", (F.col("block") == F.col("own")).alias("home")).join(first.select("node", "n", "sketch", "wide"), "node")


def join(df: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_sets (distinct sets in the component) for every row."""
    spark, work = df.sparkSession, Workspace(df.sparkSession, "ngrams")
    bounded_batches(spark)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, _ = chunk_table(rows, work, total)
    sets = find_sets(chunks, work, words, percent, max(BUCKETS, total // BUCKET_BYTES))
    work.drop("chunks", "shared")
    first, before = work.save(first_links(sets, work, percent, max(4, total // (24 << 20)), DEAL, DEAL_BYTES), "first"), "first"
    work.drop("crowded")
    for name, forest in (("forest", True), ("rest", False)):
        lists = work.save(shared_lists(first), f"{name}_lists")
        pairs = work.save(open_pairs(mixed_lists(lists, first), percent, forest), f"{name}_pairs")
        work.drop(f"{name}_lists")
        linked = count_pairs(pairs, sets, work, name, percent)
        work.drop(f"{name}_pairs", f"{name}_sets")
        first = relabel(first, linked, work, f"{name}_labels")
        work.drop(name, before)
        before = f"{name}_labels_first"
    # Sets that step 1 settled have no print: they stay out of the join, where they would all meet in one task.
    alone = sets.filter("print IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.least("n", F.lit(1)).cast("long").alias("n_sets"))
    placed = sets.filter("print IS NOT NULL").select("doc_id", "n", "print", F.shiftright("node", 20).alias("chunk"))
    # A set common to very many documents comes once from each chunk, and goes back to each chunk once.
    least = placed.groupBy("chunk", "print").agg(F.min("doc_id").alias("least"))
    by_set = first.select("print", "root").join(least.groupBy("print").agg(F.min("least").alias("least")), "print")
    summed = by_set.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n_sets"))
    told = work.save(first.select("print", "root").join(checked(summed, summed.count()), "root").select("print", "component_id", "n_sets"), "told")
    back = least.select("chunk", "print").join(told, "print")
    found = placed.join(back, ["chunk", "print"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_sets")
    result = work.save(found.unionByName(alone), "result")
    work.keep("result")
    return result


def keep_one(df: DataFrame, words: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df``, one of each component; all columns stay.  The one with the least id stays (null ids last),
    of those the one with the least hash of its columns, so that it doesn't matter how rows are dealt out.
    Rows with empty sets all stay."""
    work = Workspace(df.sparkSession, "ngrams")
    row, null, own, *marks = fresh(df.columns, "row", "null", "own", "mark1", "mark2")
    own_id = F.col(f"`{id_col}`").cast("long") if id_col in df.columns else F.lit(None).cast("long")
    first, second = row_marks(df)
    numbered = work.save(df.withColumns({row: F.monotonically_increasing_id(), null: own_id.isNull(), own: own_id, marks[0]: first, marks[1]: second}), "rows")
    joined = join(numbered.select(F.col(row).alias("doc_id"), F.col(f"`{text_col}`").alias("text")), words, percent).select(F.col("doc_id").alias(row), "component_id")
    many = joined.filter(F.col(row) != F.col("component_id")).select("component_id").distinct()
    members = joined.join(many, "component_id").join(numbered.select(row, null, own, *marks), row)
    members = work.save(members.select(row, "component_id", F.struct(null, own, *marks, row).alias("order")), "members")
    best = members.groupBy("component_id").agg(F.min("order").alias("least")).select(F.col(f"least.{row}").alias(row))
    gone = members.select(row).join(best, row, "left_anti")
    return numbered.join(checked(gone, members.count()), row, "left_anti").select(*(F.col(f"`{c}`") for c in df.columns))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


#: DuckDB: all pairs that share a shingle, counted, and what they reach.
OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM w),
e AS (SELECT r, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.r AS a, b.r AS b FROM e a JOIN e b ON a.x = b.x AND a.r <> b.r GROUP BY a.r, b.r HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(a, b) AS (SELECT r, r FROM s UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, min(t.doc_id)::BIGINT AS component_id
FROM s JOIN reach ON reach.a = s.r JOIN s t ON t.r = reach.b GROUP BY s.r, s.doc_id, s.g
"""

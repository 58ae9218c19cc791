"""MinHash near-duplicates with sequential Bayesian verification.

A document's set holds its distinct shingles of ``words`` words (A-Z lower-cased; words are runs of other
bytes than ASCII white space; a text of fewer words is one shingle).  Documents link when
100 * intersection >= percent * union; components of links come out.

1. Each set gets HASHES minima of its shingles' hashes.  Equal sets count once from here on.
2. Bands of ROWS minima name the lists of candidates.  Two sets with the similarity s share none of BANDS
   lists with probability (1 - s ** ROWS) ** BANDS: 7e-10 at 0.8, less above.
3. Candidates are compared BATCH minima at a time.  After m of n agree, the similarity's posterior (uniform
   prior) is a beta distribution; a pair leaves as soon as the probability that it reaches the threshold is
   under MISS.  ``least_matches`` has these bounds.
4. Survivors that the parity of their hashes doesn't exclude (a lower bound of the symmetric difference,
   which excludes no link) are counted exactly, on their full sets.

No list is turned into all of its pairs.  First every set is compared with the first one of each of
its lists.  Then the lists that still hold several components are compared inside: sets outside a
list's largest component with the others, in blocks of LIST.  Of what survives there, first the pairs come
out that join components, the most similar first; when those are counted, all others that still would.

Defined results: a null or empty text or one of white space has the empty set, links with nothing and is
its own component; repeated rows link with each other and are all kept if their id is the least; a null id
is never the least unless all ids of its component are null; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Workspace, as_columns, bounded_batches, rows_out, texts
from .ngram_join import LIST, WIDE_BITS, WIDE_SET, Roots, checked, components, links, parity, shingle_sets, within
from .suffix_dedup import pack_sorted, unpack_sorted

WORDS, PERCENT = 2, 80
ROWS, BANDS, BATCH = 4, 40, 16
HASHES = ROWS * BANDS
#: The posterior probability of a link below which a pair is given up.
MISS = 1e-9
#: So many partners of one set are compared in one task.
PARTNERS = 1024

SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("print", pa.binary()), ("minima", pa.binary()), ("sketch", pa.binary()), ("wide", pa.binary()), ("shingles", pa.binary())])
SETS_DDL = "doc_id long, n long, print binary, minima binary, sketch binary, wide binary, shingles binary"
#: What a comparison needs to know of a set.
KNOWN = ("n", "minima", "sketch", "wide")


@lru_cache(1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    """Of 32-bit hashes: exclusive or with a number, then times an odd one."""
    rng = np.random.default_rng(29)
    return rng.integers(0, 1 << 32, HASHES, dtype=np.uint32), rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minima(shingles: np.ndarray) -> np.ndarray:
    flip, factor = permutations()
    h, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(h), 512):
        np.minimum(least, ((h[k : k + 512, None] ^ flip) * factor).min(0), out=least)
    return least


@lru_cache
def least_matches(percent: int, miss: float = MISS, hashes: int = HASHES, batch: int = BATCH) -> tuple[int, ...]:
    """How many of the first n minima must agree, for n = batch, 2 * batch and so on.

    With m of n agreeing and a uniform prior the posterior is Beta(m + 1, n - m + 1), and the probability
    of a similarity of t or more is that of at most m successes in n + 1 trials of probability t.
    """
    t, out = percent / 100, []
    for n in range(batch, hashes + 1, batch):
        m, reached = 0, (1 - t) ** (n + 1)
        while reached < miss:
            m += 1
            reached += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def plausible(one: np.ndarray, other: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of minima (or one row) against rows: which of them survive all batches, and how many agree."""
    alive, same = np.arange(len(other)), np.zeros(len(other), np.int64)
    for k, least in enumerate(least_matches(percent)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        same[alive] += ((one[part] if one.ndim == 1 else one[alive, part]) == other[alive, part]).sum(1)
        alive = alive[same[alive] >= least]
        if not len(alive):
            break
    return alive, same


def excluded(a: tuple, b: tuple, percent: int) -> bool:
    """Do sizes or parities of (n, minima, sketch, wide) exclude a link?"""
    if 100 * min(a[0], b[0]) < percent * max(a[0], b[0]):
        return True
    far = lambda x, y: int(np.bitwise_count(np.frombuffer(x, np.uint64) ^ np.frombuffer(y, np.uint64)).sum(dtype=np.int64))
    return not within(far(a[2], b[2]), a[0] + b[0], percent) or a[3] is not None and b[3] is not None and not within(far(a[3], b[3]), a[0] + b[0], percent)


def sign(df: DataFrame, work: Workspace, words: int, id_col: str, text_col: str) -> DataFrame:
    """Each document's id, set size and print; the rest for the first of equal sets in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                seen = set()
                for doc_id, text in zip(b.column("doc_id").to_pylist(), texts(b, "text")):
                    s = shingle_sets(np.frombuffer(text, np.uint8), words)
                    if not len(s):
                        yield doc_id, 0, None, None, None, None, None
                        continue
                    mark = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    if mark in seen:
                        yield doc_id, len(s), mark, None, None, None, None
                        continue
                    seen.add(mark)
                    yield doc_id, len(s), mark, minima(s).tobytes(), parity(s), parity(s, WIDE_BITS) if len(s) > WIDE_SET else None, pack_sorted(s)

        yield from rows_out(SETS, rows(), size=lambda r: sum(len(x) for x in r[2:] if x))

    signed = df.select(*as_columns(id_col, text_col)).mapInArrow(run, SETS_DDL)
    return work.save(signed.withColumn("node", F.monotonically_increasing_id()), "signed")


def distinct_sets(signed: DataFrame, work: Workspace) -> DataFrame:
    """One row for each set: node (of one of its rows), print, and what is known of it."""
    return work.save(signed.filter(F.col("minima").isNotNull()).groupBy("print").agg(F.min("node").alias("node"), *(F.first(c).alias(c) for c in KNOWN)), "sets")


def lists_of(sets: DataFrame, work: Workspace) -> DataFrame:
    """token, node, leader of each list with more than one set; leader is its least node."""
    tokens = F.array(*(F.xxhash64(F.lit(k), F.substring("minima", 4 * ROWS * k + 1, 4 * ROWS)) for k in range(BANDS)))
    members = sets.select("node", F.explode(tokens).alias("token"))
    shared = members.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("leader")).filter("size > 1").select("token", "leader")
    return work.save(members.join(shared, "token"), "lists")


def judged(pairs: DataFrame, table: DataFrame, work: Workspace, name: str, columns: tuple[str, ...], judge: Callable[[list, list], np.ndarray]) -> DataFrame:
    """The pairs (a, b) that ``judge`` finds alike.  A set's partners stream past it, in parts of PARTNERS; it is
    sent once for each part, not once for each pair."""
    n = pairs.count()
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    used = work.save(table.select("node", *columns).join(checked(ends, 2 * n), "node", "left_semi"), f"{name}_used")
    crowded = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > PARTNERS).select("a", F.ceil(F.col("size") / PARTNERS).alias("parts"))
    placed = pairs.join(crowded, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part"))
    heads = placed.select("a", "part").distinct().join(used, F.col("a") == F.col("node")).select("a", "part", F.lit(None).cast("long").alias("b"), *columns)
    partners = placed.join(used, F.col("b") == F.col("node")).select("a", "part", "b", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            ones, others, a, b = [], [], [], []
            for x, y, *known in zip(*(batch.column(c).to_pylist() for c in ("a", "b", *columns))):
                if y is None:
                    head = known
                else:
                    ones.append(head)
                    others.append(known)
                    a.append(x)
                    b.append(y)
            if a:
                keep = pa.array(judge(ones, others), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]).filter(keep)

    streamed = heads.unionByName(partners).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    alike = work.save(streamed.mapInArrow(run, "a long, b long"), name)
    work.drop(f"{name}_used")
    return alike


def likely(pairs: DataFrame, sets: DataFrame, work: Workspace, name: str, percent: int) -> DataFrame:
    """Step 3, and step 4's exclusions."""

    def judge(ones: list, others: list) -> list[bool]:
        one, other = (np.frombuffer(b"".join(x[1] for x in side), np.uint32).reshape(-1, HASHES) for side in (ones, others))
        alive = set(plausible(one, other, percent)[0].tolist())
        return [k in alive and not excluded(ones[k], others[k], percent) for k in range(len(ones))]

    return judged(pairs, sets, work, name, KNOWN, judge)


def exact(pairs: DataFrame, signed: DataFrame, work: Workspace, name: str, percent: int) -> DataFrame:
    """Pairs that link, counted on their full sets."""

    def judge(ones: list, others: list) -> list[bool]:
        out, packed, one = [], None, None
        for (x,), (y,) in zip(ones, others):
            if x is not packed:
                packed, one = x, unpack_sorted(x)
            other = unpack_sorted(y)
            out.append(links(len(np.intersect1d(one, other, assume_unique=True)), len(one), len(other), percent))
        return out

    return judged(pairs, signed, work, name, ("shingles",), judge)


def mixed(lists: DataFrame, roots: DataFrame, sets: DataFrame, longest: int = LIST) -> DataFrame:
    """Members of lists with more than one component, in the blocks in which they are compared: a member of the
    largest one in its own, the others in all; two of these meet in the home block of the later one."""
    placed = lists.select("token", "node").join(roots, "node")
    sizes = placed.groupBy("token", "root").agg(F.count(F.lit(1)).alias("size"))
    open_ = sizes.groupBy("token").agg(F.sum("size").alias("size"), F.max(F.struct("size", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    open_ = open_.select("token", F.col("most.root").alias("most"), F.ceil(F.col("size") / longest).alias("blocks"))
    told = placed.join(open_, "token").withColumns({"major": F.col("root") == F.col("most"), "own": F.pmod(F.xxhash64("node"), F.col("blocks"))})
    spread = told.withColumn("block", F.explode(F.when(F.col("major") | (F.col("blocks") == 1), F.array("own")).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))))
    return spread.select("token", "block", "node", "root", "major", (F.col("block") == F.col("own")).alias("home")).join(sets.select("node", *KNOWN), "node")


def open_pairs(members: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs of different components in one list that survive steps 3 and 4's exclusions; with ``forest`` only those
    that join components, the most similar pairs first."""

    def compare(group: list[tuple]) -> Iterator[tuple[int, int]]:
        node, root, n = (np.array([g[k] for g in group], np.int64) for k in (0, 1, 4))
        major, home = (np.array([g[k] for g in group], bool) for k in (2, 3))
        seen = np.frombuffer(b"".join(g[5] for g in group), np.uint32).reshape(len(group), -1)
        found = []
        for k in np.flatnonzero(~major):  # the group is sorted by size
            lo, hi = np.searchsorted(n, -(-n[k] * percent // 100), "left"), np.searchsorted(n, n[k] * 100 // percent, "right")
            other = np.flatnonzero((root[lo:hi] != root[k]) & (major[lo:hi] | home[k] & (np.arange(lo, hi) < k))) + lo
            alive, same = plausible(seen[k], seen[other], percent)
            found += [(-int(same[x]), int(k), int(other[x])) for x in alive if not excluded(group[k][4:], group[other[x]][4:], percent)]
        joined = Roots()
        for _, x, y in sorted(found):
            if not forest or joined.join(int(root[x]), int(root[y])):
                yield int(min(node[x], node[y])), int(max(node[x], node[y]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            key, group = None, []
            for b in batches:
                for token, block, *member in zip(*(b.column(c).to_pylist() for c in MEMBERS)):
                    if (token, block) != key:
                        yield from compare(group) if len(group) > 1 else ()
                        key, group = (token, block), []
                    group.append(tuple(member))
            yield from compare(group) if len(group) > 1 else ()

        yield from rows_out(PAIRS, rows())

    return members.select(*MEMBERS).repartition("token", "block").sortWithinPartitions("token", "block", "n", "node").mapInArrow(run, "a long, b long").distinct()


MEMBERS = ("token", "block", "node", "root", "major", "home", *KNOWN)
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def merged(roots: DataFrame, edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """New roots after edges between sets."""
    ends = edges.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
    moved = components(ends.filter("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")), work, name)
    return work.save(roots.join(moved.select(F.col("node").alias("root"), "label"), "root", "left").select("node", F.coalesce("label", "root").alias("root")), f"{name}_roots")


def near_duplicates(df: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    spark, work = df.sparkSession, Workspace(df.sparkSession, "minhash")
    bounded_batches(spark)
    signed = sign(df, work, words, id_col, text_col)
    sets = distinct_sets(signed, work)
    lists = lists_of(sets, work)
    stars = work.save(lists.filter("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    edges = exact(likely(stars, sets, work, "likely", percent), signed, work, "linked", percent)
    roots = work.save(lists.select("node").distinct().withColumn("root", F.col("node")), "roots")
    roots = merged(roots, edges, work, "star")
    work.drop("stars", "likely", "linked")
    for name, forest in (("forest", True), ("rest", False)):
        pairs = work.save(open_pairs(mixed(lists, roots, sets), percent, forest), f"{name}_pairs")
        if not pairs.isEmpty():
            roots = merged(roots, exact(pairs, signed, work, f"{name}_linked", percent), work, name)
            work.drop(f"{name}_pairs", f"{name}_linked")
    least = signed.filter("print IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("least"))
    rooted = sets.select("print", "node").join(roots, "node", "left").select("print", F.coalesce("root", "node").alias("root")).join(least, "print")
    told = work.save(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("print", "component_id"), "told")
    found = signed.select("doc_id", "n", "print").join(told, "print", "left")
    component = F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    result = work.save(found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")), "result")
    work.keep("result")
    return result


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: DuckDB: all pairs that share a shingle, counted, and what they reach.
OP11_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM w),
e AS (SELECT r, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.r AS a, b.r AS b FROM e a JOIN e b ON a.x = b.x AND a.r <> b.r AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.r, b.r HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(a, b) AS (SELECT r, r FROM s UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, min(t.doc_id)::BIGINT AS component_id, s.doc_id IS NOT DISTINCT FROM min(t.doc_id) AS kept
FROM s JOIN reach ON reach.a = s.r JOIN s t ON t.r = reach.b GROUP BY s.r, s.doc_id, s.g
"""

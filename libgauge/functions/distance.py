"""Exact edit distance whose time follows the distance, not length times length.

Pairs at most BANDS[-1] apart are settled by Spark's own ``levenshtein`` with a threshold, which fills a
band of that width only; bands grow until the distance fits.  What is further apart goes to ``far``, an Arrow
function, as Spark has no expression for it; pairs that a band has settled don't reach it.  There, texts
that are alike are walked along their diagonals: after e edits only how far each of 2 * e + 1 diagonals
reaches matters, so the time is that of the distance's square, however long the texts.  Where the letters' counts or a
quarter of the other way's time rule that out, columns are computed by bits (Myers, in Hyyroe's form), 64 cells a
machine word: many pairs together in numpy (``together``), few ones each alone, where one big integer holds a
column's differences (``by_columns``).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import lru_cache
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

BANDS = (4, 16)
#: From this length on, numpy looks for the places of each character.
LONG = 512
#: So many words are computed at a time; groups of fewer than COMPANY aren't, as a step has its own cost.
WORDS, COMPANY = 8192, 2048
#: Words of a group's table of places; with more, as for very many different characters, the group is halved.
TABLE = 1 << 22
#: Pairs of texts up to this length aren't tried along diagonals where there is company: columns cost less than the trial.
PLAIN = 4096


def places(text: str) -> dict[str, int]:
    """For each character an integer whose bit i is set if the character is at i."""
    if len(text) < LONG:
        found: dict[str, int] = defaultdict(int)
        for i, c in enumerate(text):
            found[c] |= 1 << i
        return found
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes).tolist()}


def common(a: str, i: int, b: str, j: int) -> int:
    """How many characters agree from these places on: slices are compared, longer while they agree and then
    shorter."""
    n = min(len(a) - i, len(b) - j)
    if n <= 0 or a[i] != b[j]:
        return 0
    done, step = 1, 16
    while done < n:
        size = min(step, n - done)
        if a[i + done : i + done + size] == b[j + done : j + done + size]:
            done, step = done + size, 2 * step
        elif size == 1:
            break
        else:
            step = max(1, size // 4)
    return done


def along_diagonals(a: str, b: str, limit: int) -> int | None:
    """The distance if it is at most ``limit``.  ``reach[k]`` is how much of ``a`` the k-th diagonal has passed; diagonals from
    which the end is too far are left out."""
    n, goal, none = len(a), len(b) - len(a), -(1 << 60)
    if abs(goal) > limit:
        return None
    middle = limit + 1
    reach = [none] * (2 * limit + 3)
    reach[middle] = common(a, 0, b, 0)
    if goal == 0 and reach[middle] == n:
        return 0
    for e in range(1, limit + 1):
        new = reach[:]
        for k in range(max(-e, goal - limit + e), min(e, goal + limit - e) + 1):
            at = middle + k
            i = min(max(reach[at] + 1, reach[at - 1], reach[at + 1] + 1), n, len(b) - k)
            if i >= 0:
                i += common(a, i, b, i + k)
                new[at] = i
                if k == goal and i == n:
                    return e
        reach = new
    return None


def worth(short: int, long: int) -> int:
    """Up to which distance diagonals cost no more than a quarter of the columns' time (measured: microseconds)."""
    return int(sqrt(0.25 * (1.2 * short + 2e-4 * short * long)))


def alike(a: str, b: str) -> int | None:
    """The distance along diagonals, where letters' counts and the time don't rule that out; ``b`` isn't longer."""
    limit = worth(len(b), len(a))
    if limit > BANDS[-1] and len(a) - len(b) <= limit:
        letters = Counter(a)
        letters.subtract(b)
        if max(sum(n for n in letters.values() if n > 0), -sum(n for n in letters.values() if n < 0)) <= limit:
            return along_diagonals(a, b, limit)
    return None


def edit_distance(a: str, b: str) -> int:
    """In code points."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    near = alike(a, b)
    return by_columns(a, b) if near is None else near


def by_columns(a: str, b: str) -> int:
    """Columns run along the longer text, ``a``: fewer and wider steps."""
    at, full = places(a).get, (1 << len(a)) - 1
    up, down = full, 0  # bits where a column rises or falls by one on its way down
    for c in b:
        same = at(c, 0)
        diagonal = (((same & up) + up) ^ up) | same
        rise = ((down | (full ^ (diagonal | up))) << 1) | 1
        vertical = same | down
        up, down = (((up & diagonal) << 1) | (full ^ (vertical | rise))) & full, rise & vertical
    return len(b) + up.bit_count() - down.bit_count()


@lru_cache(1)
def _numbers() -> np.ndarray:
    """A number for each code; 0 for all, between two groups."""
    return np.zeros(0x110000, np.int64)


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _inside(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element of blocks of these sizes, its block and its place there."""
    block = np.repeat(np.arange(len(sizes)), sizes)
    return block, np.arange(len(block)) - (np.cumsum(sizes) - sizes)[block]


def steps(pair: tuple[str, str]) -> int:
    return len(pair[1]) - (-len(pair[0]) // 64) - 1


def together(pairs: list[tuple[str, str]]) -> list[int]:
    """Distances of pairs (longer, shorter), neither empty, in order of their ``steps``.

    The words of all pairs stand side by side and take a step at once: in step t a pair's word w is at column t - w, as
    the word before has handed down that column's difference in the step before.  A word that no column has reached is
    given no places and no difference, which leave it as it is.  Texts end at their last word's highest bit; free bits before
    them neither rise nor fall.  Pairs that are done leave.
    """
    size, long = len(pairs), np.array([len(a) for a, _ in pairs])
    words, columns = -(-long // 64), np.array([len(b) for _, b in pairs])
    starts = np.cumsum(words) - words
    number, down_text = _numbers(), _codes([a for a, _ in pairs])
    number[down_text] = 1
    known = np.flatnonzero(number)
    letters = len(known) + 1
    if int(words.sum()) * letters > TABLE:
        number[known] = 0
        if size == 1:
            return [by_columns(*pairs[0])]
        return together(pairs[: size // 2]) + together(pairs[size // 2 :])
    number[known] = np.arange(1, letters)
    # A table of words for each pair, letter and word: the letter's places.
    table, free = np.zeros(int(words.sum()) * letters, np.uint64), 64 * words - long
    pair, at = _inside(long)
    at += free[pair]
    np.bitwise_or.at(table, starts[pair] * letters + number[down_text] * words[pair] + (at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    # Where each column's letter stands in it, behind and before columns without places.
    pair, at = _inside(columns + 2 * words)
    along = starts[pair] * letters
    along[(at >= words[pair]) & (at < (columns + words)[pair])] += number[_codes([b for _, b in pairs])] * np.repeat(words, columns)
    number[known] = 0

    owner, word = _inside(words)
    place = (np.cumsum(columns + 2 * words) - columns - words)[owner] - word
    up = np.full(len(word), 0xFFFFFFFFFFFFFFFF, np.uint64)
    up[starts] <<= free.astype(np.uint64)
    down, rise, fall = np.zeros(len(word), np.uint64), *(np.zeros((2, len(word) + 1), np.uint64) for _ in range(2))
    rise[0, starts] = 1
    index, held = np.empty((2, len(word)), np.int64), np.empty((4, len(word)), np.uint64)
    finish, total, done, ends, last = columns + words - 1, long.copy(), 0, starts + words, np.uint64(63)
    for t in range(int(finish[-1])):
        if finish[done] <= t:
            more = int(np.searchsorted(finish, t, "right")) - done
            cut, done = int(starts[more]), done + more
            place, word, up, down, rise, fall, index, held = place[cut:], word[cut:], up[cut:], down[cut:], rise[:, cut:], fall[:, cut:], index[:, cut:], held[:, cut:]
            starts, ends = starts[more:] - cut, ends[more:] - cut
        now, then = t & 1, 1 - (t & 1)
        same, vertical, higher, lower = held
        along.take(place, out=index[0], mode="clip")
        np.add(index[0], word, out=index[1])
        table.take(index[1], out=same, mode="clip")
        place += 1
        np.bitwise_or(same, down, out=vertical)
        same |= fall[now, :-1]
        np.bitwise_and(same, up, out=lower)
        lower += up
        lower ^= up
        lower |= same  # where the diagonal doesn't rise
        np.bitwise_or(lower, up, out=higher)
        lower &= up
        np.invert(higher, out=higher)
        higher |= down
        np.right_shift(higher, last, out=rise[then, 1:])
        np.right_shift(lower, last, out=fall[then, 1:])
        higher += higher
        higher |= rise[now, :-1]
        lower += lower
        lower |= fall[now, :-1]
        np.bitwise_or(vertical, higher, out=up)
        np.invert(up, out=up)
        up |= lower
        np.bitwise_and(higher, vertical, out=down)
        total[done:] += (rise[then].take(ends) - fall[then].take(ends)).view(np.int64)
        rise[then, starts] = 1
        fall[then, starts] = 0
    return total.tolist()


def edit_distances(pairs: list[tuple[str, str]]) -> list[int]:
    """Of many pairs: those that aren't tried along diagonals are measured in groups of about WORDS words."""
    out, group, weight = [0] * len(pairs), [], 0
    ordered = [(a, b) if len(a) >= len(b) else (b, a) for a, b in pairs]
    open_ = []
    for k, (a, b) in enumerate(ordered):
        near = len(a) if not b else alike(a, b) if len(a) > PLAIN else None
        if near is None:
            open_.append(k)
        else:
            out[k] = near
    open_.sort(key=lambda k: steps(ordered[k]))
    for n, k in enumerate(open_, 1):
        group.append(k)
        weight += -(-len(ordered[k][0]) // 64)
        if weight >= WORDS or n == len(open_):
            some = [ordered[k] for k in group]
            enough = weight >= COMPANY and len(some) > 1
            for k, distance in zip(group, together(some) if enough else (edit_distance(*p) for p in some)):
                out[k] = distance
            group, weight = [], 0
    return out


def _far(left: pa.Array, right: pa.Array) -> pa.Array:
    pairs = list(zip(left.to_pylist(), right.to_pylist()))
    whole = [k for k, (a, b) in enumerate(pairs) if a is not None and b is not None]
    out: list[int | None] = [None] * len(pairs)
    for k, n in zip(whole, edit_distances([pairs[k] for k in whole])):
        out[k] = n
    return pa.array(out, pa.int32())


def banded(left: Column, right: Column, bands: tuple[int, ...] = BANDS) -> Column:
    """The distance if it is within the last band, else null.  Bands that the lengths rule out aren't tried."""
    apart = F.abs(F.length(left) - F.length(right))
    tried = (F.when(apart <= t, F.nullif(F.levenshtein(left, right, t), F.lit(-1))) for t in bands)
    return F.when(left == right, F.lit(0)).when((left == "") | (right == ""), F.greatest(F.length(left), F.length(right))).otherwise(F.coalesce(*tried))


def far(left: Column, right: Column, near: Column) -> Column:
    """``near`` where it isn't null, else the distance by diagonals or columns; null for a null text."""
    measure = F.arrow_udf(_far, "int")
    open_ = lambda x: F.when(near.isNull(), x)
    return F.coalesce(near, measure(open_(left), open_(right)))


def cost(left: Column, right: Column) -> Column:
    """What ``far`` costs: a step for each character of the shorter text, by the machine words of the longer one."""
    short, long = F.least(F.length(left), F.length(right)), F.greatest(F.length(left), F.length(right))
    return (short + 1).cast("double") * (F.lit(16.0) + long / F.lit(64.0))


def as_similarity(distance: Column, left: Column, right: Column) -> Column:
    """1 - distance / longer length, in code points; 1 for two equal texts."""
    longer = F.greatest(F.length(left), F.length(right))
    return F.when(left == right, F.lit(1.0)).otherwise(F.lit(1.0) - distance / longer.cast("double"))

"""Learning byte-level BPE merges from a table of distinct pre-tokens.

A round takes the most frequent pairs and cuts every pre-token into its
longest runs in which all neighbours are such pairs.  What one-by-one training
would merge next is decided by these runs alone, as long as the best pair there
is more frequent than every pair left out: merging creates pairs no more
frequent than those they replace, and the neighbours where a new pair begins
and ends were the same neighbours all along.  So a round sums the runs over the
whole table, replays one-by-one training on the distinct runs until it reaches
that count, and rewrites the table with all merges it found.  A few dozen
rounds give thousands of merges, equal to those of one-by-one training.

The runs that reach the driver are limited: if there are too many, the round
takes fewer pairs.  The result does not depend on that limit.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import bytelevel as bl
from glyphmill.session import remove_path, written_at

Pair = tuple[int, int]
Run = tuple[list[int], int]

FIRST_PAIRS = 256
MOST_PAIRS = 4096
MOST_RUNS = 40_000
_GAP = -1
_SUMS_AT_ONCE = 1 << 20


# -- the table of pre-tokens: ``ids`` (32-bit ids as bytes) and ``n`` ---------------


def coded(freq: DataFrame) -> DataFrame:
    """``ids, n`` of every pre-token of at least two bytes."""
    first = np.array([bl.FIRST_BYTE + o for o in bl.byte_offsets()], np.int32)

    def code(batches):
        for batch in batches:
            words = [first[np.frombuffer(w.encode(), np.uint8)].tobytes() for w in batch.column("pretoken").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), batch.column("n")], names=["ids", "n"])

    bytes_ = F.octet_length("pretoken")
    return freq.filter(bytes_ > 1).select("pretoken", F.col("n").cast("bigint")).mapInArrow(code, "ids binary, n bigint")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids with a gap after every pre-token, and the pre-token each place belongs to."""
    ids = pa.concat_arrays([batch.column("ids")])
    offsets = np.frombuffer(ids.buffers()[1], np.int32)[: len(ids) + 1] // 4
    sizes = np.diff(offsets)
    word = np.repeat(np.arange(len(ids)), sizes + 1)
    flat = np.full(len(word), _GAP, np.int32)
    place = np.arange(int(offsets[-1])) + np.repeat(np.arange(len(ids)), sizes)
    flat[place] = np.frombuffer(ids.buffers()[2], np.int32)[: offsets[-1]]
    return flat, word


def _keys(flat: np.ndarray) -> np.ndarray:
    """Every place's pair with the next one as a number, negative where either is a gap."""
    left, right = flat[:-1].astype(np.int64), flat[1:].astype(np.int64)
    return np.where((left >= 0) & (right >= 0), (left << 32) | right, -1)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(names), np.int64)
    np.add.at(total, at, n)
    return names, total


def pair_totals(table: DataFrame) -> DataFrame:
    """``pair, n``: weighted counts of neighbours, as ``left << 32 | right``; summed in the task first."""

    def count(batches):
        names, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            flat, word = _flat(batch)
            keys = _keys(flat)
            at = np.flatnonzero(keys >= 0)
            n = batch.column("n").to_numpy()[word[at]]
            names, total = _summed(np.concatenate([names, keys[at]]), np.concatenate([total, n]))
            if len(names) > _SUMS_AT_ONCE:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total)], names=["pair", "n"])
                names, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total)], names=["pair", "n"])

    return table.mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def runs_of(table: DataFrame, taken: list[int]) -> DataFrame:
    """``ids, n``: the distinct longest runs of neighbours that are all taken pairs."""
    wanted = np.sort(np.array(taken, np.int64))

    def cut(batches):
        for batch in batches:
            flat, word = _flat(batch)
            keys = _keys(flat)
            near = wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys
            # A place is inside a run if it is linked to the one before or after it.
            inside = np.zeros(len(flat), bool)
            inside[:-1] |= near
            inside[1:] |= near
            begins = inside.copy()
            begins[1:] &= ~near
            at = np.flatnonzero(inside)
            first = np.flatnonzero(begins[at])
            limits = np.append(first, len(at)).astype(np.int32) * 4
            data = pa.py_buffer(np.ascontiguousarray(flat[at]))
            runs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(limits), data])
            n = pa.array(batch.column("n").to_numpy()[word[at[first]]])
            found = pa.table({"ids": runs, "n": n}).group_by("ids").aggregate([("n", "sum")])
            for part in found.rename_columns(["ids", "n"]).combine_chunks().to_batches():
                yield part

    return table.mapInArrow(cut, "ids binary, n bigint").groupBy("ids").agg(F.sum("n").alias("n"))


def rewrite(flat: np.ndarray, merges: Iterable[Pair], first_id: int) -> np.ndarray:
    """Apply merges in order, each leftmost first."""
    for new, (left, right) in enumerate(merges, first_id):
        hit = np.flatnonzero((flat[:-1] == left) & (flat[1:] == right))
        if left == right and len(hit):
            # Of neighbouring hits every second one overlaps the one before it.
            begin = np.ones(len(hit), bool)
            begin[1:] = hit[1:] != hit[:-1] + 1
            first = np.flatnonzero(begin)
            hit = hit[(np.arange(len(hit)) - np.repeat(first, np.diff(np.append(first, len(hit))))) % 2 == 0]
        if len(hit):
            flat[hit] = new
            keep = np.ones(len(flat), bool)
            keep[hit + 1] = False
            flat = flat[keep]
    return flat


def merged(table: DataFrame, merges: list[Pair], first_id: int) -> DataFrame:
    """The table after a round's merges, without pre-tokens of one symbol."""

    def apply(batches):
        for batch in batches:
            flat = rewrite(_flat(batch)[0], merges, first_id)
            ends = np.flatnonzero(flat == _GAP)
            sizes = np.diff(np.concatenate([[-1], ends])) - 1
            keep = sizes > 1
            flat = flat[np.repeat(keep, sizes + 1) & (flat != _GAP)]
            limits = np.concatenate([[0], np.cumsum(sizes[keep])]).astype(np.int32) * 4
            data = pa.py_buffer(np.ascontiguousarray(flat))
            ids = pa.Array.from_buffers(pa.binary(), int(keep.sum()), [None, pa.py_buffer(limits), data])
            yield pa.RecordBatch.from_arrays([ids, batch.column("n").filter(pa.array(keep))], names=["ids", "n"])

    return table.mapInArrow(apply, "ids binary, n bigint")


# -- one round --------------------------------------------------------------------


def replay(runs: list[Run], wanted: int, first_id: int, above: int = 0) -> list[Pair]:
    """One-by-one training on ``(ids, n)`` while the best pair is more frequent than ``above``.

    Each change of a pair's count enters the heap, so an entry that differs
    from the count is out of date and skipped.
    """
    runs = [(list(ids), n) for ids, n in runs]
    counts: Counter[Pair] = Counter()
    holders: dict[Pair, set[int]] = defaultdict(set)
    for at, (ids, n) in enumerate(runs):
        for pair in zip(ids, ids[1:]):
            counts[pair] += n
            holders[pair].add(at)
    heap = [(-n, pair) for pair, n in counts.items()]
    heapq.heapify(heap)
    merges: list[Pair] = []
    while heap and len(merges) < wanted:
        n, pair = heapq.heappop(heap)
        if counts.get(pair) != -n:
            continue
        if -n <= above:
            break
        new, changed = first_id + len(merges), set()
        merges.append(pair)
        for at in holders.pop(pair):
            ids, n = runs[at]
            after = _replaced(ids, pair, new)
            old_pairs, new_pairs = list(zip(ids, ids[1:])), list(zip(after, after[1:]))
            for p in old_pairs:
                counts[p] -= n
            for p in new_pairs:
                counts[p] += n
            changed.update(old_pairs, new_pairs)
            for p in set(old_pairs).difference(new_pairs):
                holders[p].discard(at)
            for p in new_pairs:
                holders[p].add(at)
            runs[at] = (after, n)
        for p in changed:
            if counts[p] > 0:
                heapq.heappush(heap, (-counts[p], p))
            else:
                del counts[p]
                holders.pop(p, None)
    return merges


def _replaced(ids: list[int], pair: Pair, new: int) -> list[int]:
    """``ids`` with every ``pair`` replaced, leftmost first."""
    out, i = [], 0
    while i < len(ids):
        if ids[i] == pair[0] and i + 1 < len(ids) and ids[i + 1] == pair[1]:
            out.append(new)
            i += 2
        else:
            out.append(ids[i])
            i += 1
    return out


def independent_prefix(ranked: Iterable[Pair], limit: int) -> list[Pair]:
    """The longest head of equally frequent pairs, in rank order, that cannot touch each other.

    Merging (a, b) lowers the count of a pair only if that pair ends in a or
    starts with b.  While no pair starts with a taken right symbol or ends in a
    taken left one, the next pair is therefore also the next one one-by-one
    training would take.
    """
    taken: list[Pair] = []
    lefts: set[int] = set()
    rights: set[int] = set()
    for left, right in ranked:
        if len(taken) == limit or left in rights or right in lefts:
            break
        taken.append((left, right))
        lefts.add(left)
        rights.add(right)
    return taken


def _pair(key: int) -> Pair:
    return key >> 32, key & 0xFFFFFFFF


def next_merges(table: DataFrame, wanted: int, first_id: int, pairs: int, most_runs: int) -> tuple[list[Pair], int]:
    """The merges of one round, and how many pairs the next round may take."""
    ranked = [tuple(r) for r in pair_totals(table).orderBy(F.desc("n"), "pair").limit(pairs + 1).collect()]
    while ranked:
        above = ranked[pairs][1] if len(ranked) > pairs else 0
        taken = [key for key, n in ranked if n > above]
        if not taken:  # more equally frequent pairs than a round takes
            return independent_prefix((_pair(key) for key, _ in ranked), wanted), pairs
        found = runs_of(table, taken).limit(most_runs + 1).collect()
        if len(found) <= most_runs or len(taken) == 1:
            runs = [(np.frombuffer(ids, np.int32).tolist(), n) for ids, n in found]
            roomy = 2 * len(found) < most_runs
            return replay(runs, wanted, first_id, above), min(2 * pairs, MOST_PAIRS) if roomy else pairs
        pairs = max(1, min(pairs, len(ranked)) // 2)
    return [], pairs


def learn_merges(
    freq: DataFrame, wanted: int, pairs: int = FIRST_PAIRS, most_runs: int = MOST_RUNS
) -> Iterator[list[Pair]]:
    """Rounds of merges in rank order, from ``pretoken, n``; fewer than ``wanted`` if the text runs out.

    The table is written once a round and the one before it removed, which also
    cuts the lineage.
    """
    spark = freq.sparkSession
    table, path = written_at(coded(freq), "pretokens")
    done = 0
    while done < wanted:
        merges, pairs = next_merges(table, wanted - done, bl.FIRST_MERGE + done, pairs, most_runs)
        if not merges:
            break
        yield merges
        old = path
        if done + len(merges) < wanted:
            table, path = written_at(merged(table, merges, bl.FIRST_MERGE + done), "pretokens")
            remove_path(spark, old)
        done += len(merges)
    remove_path(spark, path)

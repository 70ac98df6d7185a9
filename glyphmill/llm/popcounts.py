"""SimHash near-duplicates by an embedding of fingerprints into segment bit counts.

A fingerprint's bits are cut into short segments, and each segment is replaced
by its number of set bits.  The Manhattan distance of two such count vectors
never exceeds the Hamming distance of the fingerprints, so it may rule pairs
out.  The counts are cut into bands; two fingerprints within the distance agree
in at least one band up to ``distance // bands``, so there a lattice point lies
within half of that of both.  Every fingerprint visits all lattice points
around its own, per band, and fingerprints that meet at a point are compared
exactly.

1.  *Near links.*  In a few turns fingerprints are ordered by the counts of
    random segments and compared inside runs of bounded length.  This joins
    large groups of near copies with one row per fingerprint and turn.
2.  *All other links.*  The grid range-join above, between different groups
    only.  Where many fingerprints meet at one point, they are cut into blocks
    and every pair of blocks is a task's own piece.  A task reports a link only
    if it joins groups that its earlier links left apart.

Step 1 only finds links sooner; step 2 alone would find every one.  What is
compared are distinct fingerprints, so exact copies cost nothing.

* Null and empty texts have the fingerprint zero and link like any other.
* Texts with fewer words than a shingle are one shingle.
* A bit is set only above half, so a bit set in exactly half the hashes is 0.
* Rows with a null ``doc_id`` take no part and get a null component.
* Repeated rows share a component; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import modest_batches
from glyphmill.llm.components import components
from glyphmill.llm.flattext import mix
from glyphmill.plans.sizing import small_side
from glyphmill.session import written

BITS = 64
_PIECE = 1 << 20
_WHITE = re.compile(rb"[ \t-\r]")
_AT_ONCE = 1 << 18


@dataclass(frozen=True)
class Params:
    shingle: int = 4
    seed: int = 42
    distance: int = 4
    segment: int = 2
    bands: int = 2
    turns: int = 3
    run: int = 1024
    # Fingerprints of one block where a lattice point is met by more.
    block: int = 2048

    @property
    def reach(self) -> int:
        """How far from its own point a fingerprint visits lattice points."""
        return -(-(self.distance // self.bands) // 2)


# -- fingerprints --------------------------------------------------------------


def shingle_hashes(text: bytes, p: Params) -> Iterator[np.ndarray]:
    """Hashes of all shingles, in pieces of bounded size."""
    held: list[bytes] = []
    at, k, seen = 0, p.shingle, False
    while at < len(text):
        cut = _WHITE.search(text, at + _PIECE) if at + _PIECE < len(text) else None
        end = cut.start() if cut else len(text)
        words = held + text[at:end].lower().split()
        at = end
        if len(words) >= k:
            line = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            begins = np.concatenate([[0], ends[:-k] + 1]).tolist()
            hashes = [xxhash.xxh64_intdigest(line[a:b], p.seed) for a, b in zip(begins, ends[k - 1 :].tolist())]
            yield np.array(hashes, np.uint64)
            seen, words = True, words[-k + 1 :] if k > 1 else []
        held = words
    if held and not seen:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), p.seed)], np.uint64)


def fingerprint(text: bytes, p: Params = Params()) -> int:
    """Bit i is set where more than half of the shingle hashes have it."""
    votes, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, p):
        octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, p: Params) -> DataFrame:
    """``doc_id, fp`` of every row."""

    def compute(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            found = np.array([fingerprint(t.as_py() or b"", p) for t in texts], np.uint64)
            ids = batch.column("doc_id").cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(compute, "doc_id bigint, fp bigint")


# -- the embedding -------------------------------------------------------------


def segment_counts(fps: np.ndarray, segment: int) -> np.ndarray:
    """Per fingerprint the number of set bits of each segment."""
    shifts = np.arange(0, BITS, segment, dtype=np.uint64)
    return np.bitwise_count((fps[:, None] >> shifts) & np.uint64((1 << segment) - 1)).astype(np.int64)


def points(fps: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """The lattice points every fingerprint visits, as 64-bit keys, and the row of each."""
    keys, rows = [], []
    for band, counts in enumerate(np.array_split(segment_counts(fps, p.segment), p.bands, axis=1)):
        sizes = np.full(counts.shape[1], p.segment)
        place = np.arange(len(fps))
        visited, owner = counts, place
        edge, edge_owner = counts, place
        for _ in range(p.reach):
            steps = []
            for step in (1, -1):
                free = (edge < sizes) if step > 0 else (edge > 0)
                row, column = np.nonzero(free)
                near = edge[row]
                near[np.arange(len(row)), column] += step
                steps.append((near, edge_owner[row]))
            edge = np.concatenate([s[0] for s in steps])
            edge_owner = np.concatenate([s[1] for s in steps])
            visited, owner = np.concatenate([visited, edge]), np.concatenate([owner, edge_owner])
        # A mixed radix number, so no two points of a band share a key.
        radix = np.uint64(p.segment + 1) ** np.arange(counts.shape[1], dtype=np.uint64)
        key = (visited.astype(np.uint64) * radix).sum(axis=1, dtype=np.uint64) * np.uint64(p.bands) + np.uint64(band)
        if p.reach > 1:
            pair = np.unique(np.stack([owner.astype(np.uint64), key]), axis=1)
            owner, key = pair[0].astype(np.int64), pair[1]
        keys.append(key.view(np.int64))
        rows.append(owner)
    return np.concatenate(keys), np.concatenate(rows)


# -- comparing -----------------------------------------------------------------


class Forest:
    """Groups joined so far."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def top(self, x: int) -> int:
        path = []
        while (up := self.above.get(x, x)) != x:
            path.append(x)
            x = up
        for y in path:
            self.above[y] = x
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether ``x`` and ``y`` were apart until now."""
        x, y = self.top(x), self.top(y)
        if x != y:
            self.above[max(x, y)] = min(x, y)
        return x != y


def linked(fps, ends, skip, p: Params) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs within the distance: row i against those from ``skip[i]`` up to ``ends[i]``."""
    counts = np.maximum(ends - skip, 0)
    total = np.concatenate([[0], np.cumsum(counts)])
    begin = 0
    while begin < len(fps):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + _AT_ONCE, "right")) - 1)
        a = np.repeat(np.arange(begin, end), counts[begin:end])
        b = skip[a] + np.arange(len(a)) - np.repeat(total[begin:end] - total[begin], counts[begin:end])
        near = np.bitwise_count(fps[a] ^ fps[b]) <= p.distance
        yield a[near], b[near]
        begin = end


def _edges(left: list[int], right: list[int]) -> pa.RecordBatch:
    arrays = [pa.array(left, pa.int64()), pa.array(right, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["a", "b"])


def near_links(classes: DataFrame, p: Params) -> DataFrame:
    """Links ``a, b`` between fingerprints found in a few turns; at most one per fingerprint and turn."""
    segments = BITS // p.segment

    def keyed(turn: int):
        order = np.argsort(mix(np.arange(segments, dtype=np.uint64) + np.uint64(1000 * turn + 1)))

        def key(batches):
            for batch in batches:
                fps = batch.column("fp").to_numpy().view(np.uint64)
                counts = segment_counts(fps, p.segment)[:, order]
                near = np.zeros(len(fps), np.uint64)
                for c in counts.T[: 62 // max(1, p.segment.bit_length())]:
                    near = (near << np.uint64(p.segment.bit_length())) | c.astype(np.uint64)
                arrays = [pa.array(near.view(np.int64)), batch.column("fp")]
                yield pa.RecordBatch.from_arrays(arrays, names=["near", "fp"])

        return key

    def compare(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, p.run):
                fps = batch.column("fp").slice(at, p.run).to_numpy().view(np.uint64)
                n, forest = len(fps), Forest()
                left, right = [], []
                ends, skip = np.full(n, n), np.arange(1, n + 1)
                for a, b in linked(fps, ends, skip, p):
                    for x, y in zip(a.tolist(), b.tolist()):
                        if forest.join(x, y):
                            left.append(x)
                            right.append(y)
                signed = fps.view(np.int64)
                yield _edges(signed[left], signed[right])

    found = None
    for turn in range(p.turns):
        rows = classes.select("fp").mapInArrow(keyed(turn), "near bigint, fp bigint")
        # Ranges cut the order of the keys evenly, so a dense spot spreads over tasks.
        rows = rows.repartitionByRange("near", "fp").sortWithinPartitions("near", "fp")
        links = rows.mapInArrow(compare, "a bigint, b bigint")
        found = links if found is None else found.unionByName(links)
    return written(found, "near-links")


def visits(grouped: DataFrame, p: Params) -> DataFrame:
    """``point, fp, grp``: every lattice point a fingerprint visits."""

    def walk(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                key, row = points(part.column("fp").to_numpy().view(np.uint64), p)
                own = part.take(pa.array(row))
                arrays = [pa.array(key), own.column("fp"), own.column("grp")]
                yield pa.RecordBatch.from_arrays(arrays, names=["point", "fp", "grp"])

    return grouped.select("fp", "grp").mapInArrow(walk, "point bigint, fp bigint, grp bigint")


def far_links(grouped: DataFrame, p: Params) -> DataFrame:
    """Links ``a, b`` between groups that the grid range-join finds."""
    met = visits(grouped, p)
    crowded = met.groupBy("point").agg(F.count("*").alias("size"), F.min("grp").alias("low"), F.max("grp").alias("high"))
    crowded = crowded.filter((F.col("size") > p.block) & (F.col("low") != F.col("high")))
    crowded = crowded.select("point", F.ceil(F.col("size") / p.block).cast("int").alias("blocks"))
    crowded = written(crowded, "crowded")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    blocks = met.join(small_side(crowded), "point", "left").withColumn("mine", mine)
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    blocks = blocks.withColumn("other", other).withColumn("mine", F.coalesce("mine", F.lit(0)))
    blocks = blocks.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")})
    cut = ["point", "i", "j"]
    blocks = blocks.select(*cut, "mine", "fp", "grp").repartition(*cut).sortWithinPartitions(*cut, "grp", "fp")

    def starts(t: pa.Table, *names: str) -> np.ndarray:
        new = np.ones(len(t), bool)
        new[1:] = np.any([(c := t.column(x).to_numpy())[1:] != c[:-1] for x in names], axis=0)
        return new

    def ends_of(new: np.ndarray) -> np.ndarray:
        """For every row the end of its run."""
        first = np.append(np.flatnonzero(new), len(new))
        return first[np.cumsum(new)]

    def links_of(t: pa.Table, forest: Forest) -> pa.RecordBatch:
        fps, grp = t.column("fp").to_numpy().view(np.uint64), t.column("grp").to_numpy()
        part, crossing = t.column("mine").to_numpy(), t.column("i").to_numpy() != t.column("j").to_numpy()
        left, right = [], []
        # Rows are ordered by group, so a row's partners begin where its group ends.
        for a, b in linked(fps, ends_of(starts(t, *cut)), ends_of(starts(t, *cut, "grp")), p):
            ok = ~crossing[a] | (part[a] != part[b])
            pair = np.unique(np.stack([grp[a[ok]], grp[b[ok]]]), axis=1)
            for x, y in pair.T.tolist():
                if forest.join(x, y):
                    left.append(x)
                    right.append(y)
        return _edges(left, right)

    def compare(batches):
        held, forest = None, Forest()
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            last = int(np.flatnonzero(starts(held, *cut))[-1]) if len(held) else 0
            if last:
                yield links_of(held.slice(0, last), forest)
                held = held.slice(last)
        if held is not None and len(held):
            yield links_of(held, forest)

    return written(blocks.mapInArrow(compare, "a bigint, b bigint"), "far-links")


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``."""
    modest_batches(docs.sparkSession)
    found = written(fingerprints(docs, p), "fingerprints")
    classes = found.filter(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("rep"))
    classes = written(classes, "fingerprint-classes")

    def labelled(links: DataFrame, rows: DataFrame, of: str, name: str) -> DataFrame:
        labels = components(links).select(F.col("node").alias(of), "label")
        return rows.join(labels, of, "left").withColumn(name, F.coalesce("label", of)).drop("label")

    grouped = written(labelled(near_links(classes, p), classes, "fp", "grp"), "fingerprint-groups")
    joined = written(labelled(far_links(grouped, p), grouped, "grp", "whole"), "fingerprint-wholes")
    smallest = joined.groupBy("whole").agg(F.min("rep").alias("component"))
    named = written(joined.join(smallest, "whole").select("fp", "component"), "fingerprint-components")
    rows = found.join(small_side(named), "fp", "left")
    return rows.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"),
    )

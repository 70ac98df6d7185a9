"""Exact Jaccard join of documents on word shingles, and its connected components.

Texts with equal shingle sets form one class; all work is between classes.

1.  *Near links.*  Band keys of minhashes send each class to a leader of its
    band, in a few turns with other leaders; those pairs are verified exactly
    and joined to groups.  This settles large groups of near copies with a few
    comparisons per member.
2.  *All other links.*  By the prefix principle two sets that reach the
    threshold share one of their first ``n - ceil(t * n) + 1`` shingles in any
    common order; the order used here puts shingles rare in the corpus first.
    Classes sharing such a shingle meet in a tile, cut by size band (sets whose
    sizes differ too much cannot link) and, where a tile is large, into pairs
    of blocks.  Tiles whose classes are all in one group are done already.
    Inside a tile, 1024-bit hashed bitmaps bound each pair's overlap from above;
    what passes is verified by intersecting the sorted shingle arrays.

Nothing is dropped on the way: step 1 only finds links sooner, and the order of
step 2 only moves work.

* Null and empty texts have no shingles and link with nothing.
* Texts under five words are one shingle, their whole word sequence.
* Rows with a null ``doc_id`` take no part and get a null component.
* Repeated rows are members of one class; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from glyphmill.llm.common import boxed, modest_batches
from glyphmill.llm.components import contracted
from glyphmill.llm.flattext import flat, mix, slices, word_hashes, word_limits
from glyphmill.plans.sizing import small_side
from glyphmill.session import remove_path, written, written_at

BLOCK = 4096
# Small batches and runs of texts: two tasks of an executor hold several of each at once, beside its heap.
BATCH_BYTES = 4 << 20
SLICE_BYTES = 2 << 20
SIGNATURE_BITS = 1024
PAIRS_AT_ONCE = 1 << 17
FIRST_TILES = 12
SKETCH = "doc_id bigint, key binary, n bigint, bits binary, bands array<bigint>, block int, counts array<bigint>"


@dataclass(frozen=True)
class Params:
    shingle: int = 5
    percent: int = 75
    bands: int = 4
    rows: int = 2
    rounds: int = 3
    tile: int = 2048
    # Hashed shingle counters (a power of two).  More of them tell frequent
    # shingles from rare ones in a larger corpus; results do not depend on them.
    slots: int = 1 << 20

    def slot(self, shingles: np.ndarray) -> np.ndarray:
        return (shingles >> np.uint64(65 - self.slots.bit_length())).astype(np.int64)

    def needed(self, total):
        """The least overlap of two sets whose sizes sum to ``total``."""
        return -(-self.percent * total // (100 + self.percent))

    def prefix(self, n):
        return n + (-self.percent * n // 100) + 1


def shingle_sets(texts: pa.Array, p: Params) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles."""
    data, offsets = flat(texts)
    starts, ends, first = word_limits(data, offsets)
    words = word_hashes(data, starts, ends, lower=True)
    k, base = p.shingle, np.uint64(0xC2B2AE3D27D4EB4F)
    if len(words) >= k:
        h = words[: len(words) - k + 1].copy()
        for j in range(1, k):
            h = h * base + words[j : len(words) - k + 1 + j]
        h = mix(h + np.uint64(k))
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            own = np.sort(h[a : b - k + 1])
            new = np.empty(len(own), bool)
            new[0] = True
            np.not_equal(own[1:], own[:-1], out=new[1:])
            yield own[new]
        elif b > a:
            one = words[a]
            for w in words[a + 1 : b]:
                one = np.uint64((int(one) * int(base) + int(w)) & (2**64 - 1))
            yield mix(np.array([one], np.uint64) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.md5(shingles.tobytes(), usedforsecurity=False).digest()


def _signature(shingles: np.ndarray) -> bytes:
    bits = np.zeros(SIGNATURE_BITS, bool)
    bits[(shingles >> np.uint64(65 - SIGNATURE_BITS.bit_length())).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def sketches(docs: DataFrame, p: Params) -> DataFrame:
    """One pass over the texts: a row per document, and per task a table of hashed shingle counts."""

    def sketch(batches):
        counts = np.zeros(p.slots, np.int64)
        odd = mix(np.arange(1, p.bands * p.rows + 1, dtype=np.uint64)) | np.uint64(1)
        empty = pa.scalar(None, pa.list_(pa.int64()))
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for at, texts in slices(batch.column("text"), SLICE_BYTES):
                keys, sizes, bits, bands = [], [], [], []
                for s in shingle_sets(texts, p):
                    sizes.append(len(s))
                    if not len(s):
                        keys.append(None), bits.append(None), bands.append(None)
                        continue
                    keys.append(set_key(s))
                    bits.append(_signature(s))
                    least = mix(np.array([(s * a).min() for a in odd])).reshape(p.bands, p.rows)
                    folded = least[:, 0]
                    for r in range(1, p.rows):
                        folded = mix(folded * np.uint64(0xC2B2AE3D27D4EB4F) + least[:, r])
                    bands.append(folded.view(np.int64).tolist())
                    np.add.at(counts, p.slot(s), 1)
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, n),
                        pa.array(keys, pa.binary()),
                        pa.array(sizes, pa.int64()),
                        pa.array(bits, pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                        pa.nulls(n, pa.int32()),
                        pa.array([empty.as_py()] * n, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "key", "n", "bits", "bands", "block", "counts"],
                )
        for block in np.flatnonzero(counts.reshape(-1, BLOCK).any(axis=1)):
            own = counts[block * BLOCK : (block + 1) * BLOCK]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(1, pa.int64()),
                    pa.nulls(1, pa.binary()),
                    pa.nulls(1, pa.int64()),
                    pa.nulls(1, pa.binary()),
                    pa.nulls(1, pa.list_(pa.int64())),
                    pa.array([block], pa.int32()),
                    pa.array([own], pa.list_(pa.int64())),
                ],
                names=["doc_id", "key", "n", "bits", "bands", "block", "counts"],
            )

    return docs.select("doc_id", "text").mapInArrow(sketch, SKETCH)


def rarity_levels(sketch: DataFrame, p: Params) -> np.ndarray:
    """A level per hash slot: 0 for the usual count, more for slots with frequent shingles.

    Rare shingles alone fill slots like random throws, so a count three
    deviations above the median tells of a frequent one.  ``slots`` sums reach
    the driver, whatever the corpus.  Levels decide the order of shingles only,
    never what links.
    """
    tables = sketch.filter(F.col("block").isNotNull())
    cells = tables.select("block", F.posexplode("counts").alias("pos", "n")).filter(F.col("n") > 0)
    slot = (F.col("block") * BLOCK + F.col("pos")).alias("slot")
    total = np.zeros(p.slots, np.float64)
    for part in cells.groupBy(slot).agg(F.sum("n").alias("n")).toArrow().to_batches():
        total[part.column("slot").to_numpy()] = part.column("n").to_numpy()
    middle = np.median(total)
    usual = middle + 3 * np.sqrt(middle) + 2
    level = np.log2(np.maximum(total - middle, 1)).astype(int)
    return np.where(total > usual, level, 0).clip(0, 255).astype(np.uint8)


def shared_prefixes(docs: DataFrame, levels: np.ndarray, p: Params) -> DataFrame:
    """``h, k1``: prefix shingles that at least two classes have (``k1``: the class key's first 8 bytes).

    One shuffle by shingle.  A cold shingle's rows are few (its slot is near the
    mean) and meet in one sorted run, where lone ones are dropped as they pass;
    a hot shingle needs no such test, so its rows are salted.
    """

    def prefixes(batches):
        for batch in batches:
            keep = batch.filter(pc.is_valid(batch.column("doc_id")))
            for _, texts in slices(keep.column("text"), SLICE_BYTES):
                hs, ks, salts = [], [], []
                for s in shingle_sets(texts, p):
                    if not len(s):
                        continue
                    size = p.prefix(len(s))
                    level = levels[p.slot(s)]
                    first = np.argsort(level, kind="stable")[:size] if level.any() else slice(0, size)
                    key = int.from_bytes(set_key(s)[:8], "big", signed=True)
                    hs.append(s[first].view(np.int64))
                    ks.append(np.full(size, key, np.int64))
                    salts.append(np.where(level[first] > 0, 1 + key % 64, 0).astype(np.int32))
                if hs:
                    arrays = [pa.array(np.concatenate(c)) for c in (hs, ks, salts)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["h", "k1", "salt"])

    def drop_lone(batches):
        last, linked = None, False
        for batch in batches:
            h, k, salt = (batch.column(c).to_numpy() for c in ("h", "k1", "salt"))
            if last is not None:
                h, k, salt = (np.concatenate([[x], y]) for x, y in zip(last, (h, k, salt)))
            if not len(h):
                continue
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
            h, k, salt = h[new], k[new], salt[new]
            same = h[1:] == h[:-1]
            keep = salt > 0
            keep[1:] |= same
            keep[:-1] |= same
            keep[0] |= linked
            last, linked = (h[-1], k[-1], salt[-1]), bool(keep[-1])
            out = keep[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(h[:-1][out]), pa.array(k[:-1][out])], names=["h", "k1"])
        if linked:
            yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in last[:2]], names=["h", "k1"])

    rows = docs.select("doc_id", "text").mapInArrow(prefixes, "h bigint, k1 bigint, salt int")
    return rows.repartition("h", "salt").sortWithinPartitions("h", "k1").mapInArrow(drop_lone, "h bigint, k1 bigint")


def wide_signature(shingles: np.ndarray, bits: int) -> bytes:
    """A hashed bitmap of ``bits`` bits, a power of two."""
    found = np.zeros(bits, bool)
    found[(shingles >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64)] = True
    return np.packbits(found).tobytes()


def set_data(docs: DataFrame, wanted: DataFrame, schema: str, p: Params) -> DataFrame:
    """``wanted`` (``rep, key, bits, ...``) with the class's sorted shingles as ``data``, or a bitmap where ``bits`` > 0.

    Only the wanted texts are cut into shingles again; a text is matched by the
    key of its set, so another text under the same id is no harm.
    """
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def compute(batches):
        for batch in batches:
            keys, bits = batch.column("key").to_pylist(), batch.column("bits").to_pylist()
            for at, texts in slices(batch.column("text"), SLICE_BYTES):
                rows, data = [], []
                for i, s in enumerate(shingle_sets(texts, p), at):
                    if len(s) and set_key(s) == keys[i]:
                        rows.append(i)
                        data.append(wide_signature(s, bits[i]) if bits[i] else s.tobytes())
                kept = batch.take(pa.array(rows, pa.int64())).select(names)
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(data, pa.binary())], names=[*names, "data"])

    wanted = small_side(wanted.withColumnRenamed("rep", "doc_id"))
    return docs.select("doc_id", "text").join(wanted, "doc_id").mapInArrow(compute, schema + ", data binary")


def _verify(pairs: DataFrame, docs: DataFrame, p: Params, exact: bool) -> DataFrame:
    """Pairs that pass: by the intersection of their sorted arrays, or by the bound of their bitmaps."""
    size = F.lit(0)
    if not exact:  # about four bits a shingle
        size = F.pow(F.lit(2), F.ceil(F.log2(F.col("n_a") * 4 + 512.0))).cast("int")
    pairs = pairs.withColumn("bits", size)
    ends = pairs.select(F.col("rep_b").alias("rep"), F.col("b").alias("key"), "bits").distinct()
    if exact:  # nearly all of these pairs link, and an end has few of them
        left = set_data(
            docs,
            pairs.select(F.col("rep_a").alias("rep"), F.col("a").alias("key"), "bits", "b", "n_a", "n_b", "rep_a", "rep_b"),
            "key binary, b binary, bits int, n_a bigint, n_b bigint, rep_a bigint, rep_b bigint",
            p,
        ).withColumnRenamed("key", "a")
        right = set_data(docs, ends, "key binary, bits int", p)
    else:
        more = pairs.select(F.col("rep_a").alias("rep"), F.col("a").alias("key"), "bits")
        right = written(set_data(docs, ends.union(more).distinct(), "key binary, bits int", p), "bitmaps")
        left = pairs.join(right.withColumnRenamed("key", "a"), ["a", "bits"])
    right = right.select(F.col("key").alias("b"), "bits", F.col("data").alias("other"))
    met = left.join(right, ["b", "bits"])

    def check(batches):
        for batch in batches:
            keep = []
            columns = (batch.column(c) for c in ("data", "other", "n_a", "n_b"))
            for x, y, n_a, n_b in zip(*columns):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if exact:
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")
                    shared = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * shared >= p.percent * (len(both) - shared))
                else:
                    n_a, n_b = n_a.as_py(), n_b.as_py()
                    lack = int(np.bitwise_count(x & ~y).sum())
                    extra = int(np.bitwise_count(y & ~x).sum())
                    keep.append(min(n_a - lack, n_b - extra) >= p.needed(n_a + n_b))
            yield batch.select(PAIR).filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(check, "a binary, b binary, n_a bigint, n_b bigint, rep_a bigint, rep_b bigint")


PAIR = ["a", "b", "n_a", "n_b", "rep_a", "rep_b"]


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, p: Params, likely: bool) -> DataFrame:
    """The pairs ``a, b`` whose sorted arrays overlap enough.

    Pairs that are not ``likely`` to link first pass wide bitmaps, an upper
    bound from a sixteenth of the data.
    """
    of = classes.select("key", "n", "rep")
    ends = [of.select(F.col("key").alias(e), F.col("n").alias(f"n_{e}"), F.col("rep").alias(f"rep_{e}")) for e in "ab"]
    pairs = written(pairs.select("a", "b").distinct().join(ends[0], "a").join(ends[1], "b").select(PAIR), "pairs")
    if not likely:
        pairs = written(_verify(pairs, docs, p, exact=False), "bounded-pairs")
    return written(_verify(pairs, docs, p, exact=True).select("a", "b").distinct(), "links")


def near_pairs(classes: DataFrame, turn: int) -> DataFrame:
    """Each class with the leader of every band value it shares, where they are in different groups.

    ``classes`` holds ``key, bands, group``.  The leader is the first class in
    a hash order that changes with ``turn``.
    """
    bands = classes.select("key", "group", F.posexplode("bands").alias("band", "value"))
    first = F.struct(F.xxhash64(F.lit(turn), F.col("key")).alias("h"), F.col("key").alias("b"), F.col("group").alias("g"))
    leaders = bands.groupBy("band", "value").agg(
        F.min(first).alias("first"), F.min("group").alias("low"), F.max("group").alias("high")
    )
    leaders = written(leaders.filter(F.col("low") != F.col("high")).select("band", "value", "first.*"), "leaders")
    pairs = bands.join(leaders, ["band", "value"]).filter(F.col("group") != F.col("g"))
    return pairs.select(F.col("key").alias("a"), "b")


def regrouped(grouped: DataFrame, links: DataFrame) -> DataFrame:
    """``grouped`` with the groups that ``links`` join made one."""
    labels = small_side(contracted(links, grouped))
    return grouped.join(labels, "group", "left").select(
        *[c for c in grouped.columns if c != "group"], F.coalesce("label", "group").alias("group")
    )


def near_groups(classes: DataFrame, docs: DataFrame, p: Params) -> DataFrame:
    """The classes' ``key, k1, bands`` with the ``group`` that verified links to leaders make them.

    A member may miss one leader and meet the next, so a large group of near
    copies is joined in a few turns, each with at most one comparison per band
    and member.
    """
    grouped = classes.select("key", "k1", "bands").withColumn("group", F.col("key"))
    for turn in range(p.rounds):
        found = verified(near_pairs(grouped, turn), classes, docs, p, likely=True)
        if not found.limit(1).count():
            break
        grouped = written(regrouped(grouped, found), "grouped")
    return grouped


def tile_pairs(prefixes: DataFrame, grouped: DataFrame, classes: DataFrame, p: Params) -> DataFrame:
    """Candidate pairs between different groups, from the tiles of shared prefix shingles."""
    spark = prefixes.sparkSession
    met, met_path = written_at(
        prefixes.join(grouped.select("k1", "key", "group"), "k1").select("h", "key", "group"), "tile-members"
    )
    # Near copies share many shingles, so many tiles hold the same classes; one of each is enough.
    same = [F.bit_xor(F.xxhash64(F.lit(k), F.col("key"))).alias(f"x{k}") for k in (1, 2)]
    mixed = met.groupBy("h").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("m"), *same)
    mixed = mixed.filter(F.col("low") != F.col("high")).groupBy("m", "x1", "x2").agg(F.min("h").alias("h"))
    own_tiles = written(met.join(mixed.select("h", "m"), "h"), "own-tiles")
    remove_path(spark, met_path)
    # A pair belongs to the first tile it shares; the first few tiles of each class tell most repeats.
    firsts = own_tiles.groupBy("key").agg(F.slice(F.sort_array(F.collect_list("h")), 1, FIRST_TILES).alias("firsts"))
    of = classes.select("key", "n", "bits").join(firsts, "key")
    rows = own_tiles.join(written(of, "tile-classes"), "key")
    # Only crowded tiles are cut: into size bands as wide as the largest size ratio of a link (a set meets its own
    # band and, as the larger one, the band below), and those into pairs of blocks.
    crowded = F.col("m") > p.tile
    home = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / p.percent)) + 1e-9)
    bands = F.when(crowded, F.array(home, home - 1)).otherwise(F.array(F.lit(0).cast("bigint")))
    rows = rows.withColumn("band", F.explode(bands)).withColumn("visits", crowded & (F.col("band") != home))
    parts = F.when(crowded, F.ceil(F.col("m") / p.tile)).otherwise(1).cast("int")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("key"), parts).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))).withColumns(
        {"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}
    )

    def pairs_of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """All pairs of a run of whole tiles that the sizes and bitmaps allow."""
        if not len(t):
            return
        n, own = t.column("n").to_numpy(), ~t.column("visits").to_numpy()
        part, crossing = t.column("mine").to_numpy(), t.column("i").to_numpy() != t.column("j").to_numpy()
        keys = t.column("key").combine_chunks()
        group = np.frombuffer(b"".join(t.column("group").to_pylist()), np.uint64).reshape(-1, 2)
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(len(n), -1)
        tile = np.cumsum(_tile_starts(t)) - 1
        here, lists = t.column("h").to_numpy(), t.column("firsts").combine_chunks()
        size = pc.list_value_length(lists).to_numpy()
        firsts = np.full((len(n), FIRST_TILES), np.iinfo(np.int64).max)
        firsts[np.arange(FIRST_TILES) < size[:, None]] = lists.flatten().to_numpy()
        firsts[firsts >= here[:, None]] = np.iinfo(np.int64).max  # only tiles before this one
        # Rows are ordered by tile and size, so a row's partners are the next rows up to its size limit.
        place = tile * (n.max() * 2 + 2) + n
        ends = np.searchsorted(place, place - n + n * 100 // p.percent, "right")
        counts = np.maximum(ends - np.arange(len(n)) - 1, 0)
        total = np.concatenate([[0], np.cumsum(counts)])
        begin = 0
        while begin < len(n):
            end = max(begin + 1, int(np.searchsorted(total, total[begin] + PAIRS_AT_ONCE, "right")) - 1)
            a = np.repeat(np.arange(begin, end), counts[begin:end])
            b = a + 1 + np.arange(len(a)) - np.repeat(total[begin:end] - total[begin], counts[begin:end])
            ok = (group[a] != group[b]).any(axis=1) & (own[a] | own[b]) & (~crossing[a] | (part[a] != part[b]))
            a, b = a[ok], b[ok]
            met_before = np.zeros(len(a), bool)
            for k in range(FIRST_TILES):
                x = firsts[a, k]
                met_before |= (x < here[a]) & (firsts[b] == x[:, None]).any(axis=1)
            a, b = a[~met_before], b[~met_before]
            lack = np.bitwise_count(bits[a] & ~bits[b]).sum(axis=1, dtype=np.int64)
            extra = np.bitwise_count(bits[b] & ~bits[a]).sum(axis=1, dtype=np.int64)
            ok = np.minimum(n[a] - lack, n[b] - extra) >= p.needed(n[a] + n[b])
            found = pa.table({"a": keys.take(pa.array(a[ok])), "b": keys.take(pa.array(b[ok]))})
            yield from found.group_by(["a", "b"]).aggregate([]).to_batches()
            begin = end

    def compare(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            last = int(np.flatnonzero(_tile_starts(held))[-1]) if len(held) else 0
            if last:
                yield from pairs_of(held.slice(0, last))
                held = held.slice(last)
        if held is not None:
            yield from pairs_of(held)

    cut = ["h", "band", "i", "j"]
    rows = rows.select(*cut, "n", "key", "group", "bits", "visits", "mine", "firsts")
    rows = rows.repartition(*cut).sortWithinPartitions(*cut, "n", "key")
    return rows.mapInArrow(compare, "a binary, b binary")


def _tile_starts(t: pa.Table) -> np.ndarray:
    """Whether each row of a table ordered by tile begins a tile."""
    new = np.ones(len(t), bool)
    cut = [t.column(c).to_numpy() for c in ("h", "band", "i", "j")]
    new[1:] = np.any([c[1:] != c[:-1] for c in cut], axis=0)
    return new


def near_duplicates(docs: DataFrame, p: Params = Params(), with_key: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``; ``with_key`` adds the key of its set."""
    modest_batches(docs.sparkSession, BATCH_BYTES)
    sketch = written(sketches(docs, p), "sketches")
    members = sketch.filter(F.col("block").isNull()).select("doc_id", "key", "n", "bits", "bands")
    known = members.filter(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
    classes = known.groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.any_value(F.struct("n", "bits", "bands")).alias("of")
    )
    k1 = F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("bigint")
    classes = written(classes.select("key", k1.alias("k1"), "rep", "of.*"), "classes")

    grouped = near_groups(classes, docs, p)
    prefixes, path = written_at(shared_prefixes(docs, rarity_levels(sketch, p), p), "prefixes")
    candidates = tile_pairs(prefixes, grouped, classes, p)
    remove_path(docs.sparkSession, path)
    far = verified(candidates, classes, docs, p, likely=False)
    joined = regrouped(grouped.select("key", "group"), far).withColumnRenamed("group", "label")
    named = written(classes.select("key", "rep").join(joined, "key"), "named")
    smallest = written(named.groupBy("label").agg(F.min("rep").alias("component")), "smallest")
    named = written(named.join(smallest, "label").select("key", "component"), "class-components")
    rows = members.select("doc_id", "key", "n").join(named, "key", "left")
    return rows.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        *([F.col("key").alias("set_key")] if with_key else []),
    )


def keyed(docs: DataFrame, p: Params) -> DataFrame:
    """``docs`` (``doc_id, text`` and others) with the key of each text's set as ``set_key``, null without shingles."""

    def compute(batches):
        for batch in batches:
            for at, texts in slices(batch.column("text"), SLICE_BYTES):
                keys = [set_key(s) if len(s) else None for s in shingle_sets(texts, p)]
                part = batch.slice(at, len(keys))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.binary())], names=[*part.schema.names, "set_key"])

    return docs.mapInArrow(compute, StructType([*docs.schema, StructField("set_key", BinaryType())]))


def keep_one(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One row of ``docs`` per component, under its smallest id, and all rows without an id.

    Ids are nearly always unique, and then the id tells the row.  Of rows that
    share an id, those stay whose own text leads its component, one of each.
    """
    found = near_duplicates(docs, p, with_key=True).filter(F.col("doc_id") == F.col("component_id"))
    found = written(found.select(F.col("doc_id").alias("kept_id"), F.col("set_key").alias("kept_key")).distinct(), "kept-ids")
    ids = docs.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("kept_id")).agg(F.count("*").alias("n"))
    shared = small_side(written(ids.filter("n > 1").select("kept_id"), "shared-ids"))
    same = F.col("doc_id") == F.col("kept_id")
    alone = docs.join(shared, same, "left_anti").filter(F.col("doc_id").isNotNull())
    alone = alone.join(small_side(found.select("kept_id").distinct()), same, "left_semi")
    several = boxed(docs.join(shared, same, "left_semi")).select("row", "row.doc_id", "row.text")
    several = keyed(several, p).join(small_side(found), same & F.col("set_key").eqNullSafe(F.col("kept_key")), "left_semi")
    one = several.groupBy("doc_id", "set_key").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    nameless = docs.filter(F.col("doc_id").isNull())
    return alone.unionByName(one.select("row.*")).unionByName(nameless)

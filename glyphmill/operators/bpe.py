"""Byte-level BPE as Spark jobs: train, encode, decode, cost reports.

Training works on the table of distinct pre-tokens; encoding is map-only, so a
corpus of any size is tokenized without a shuffle.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import bytelevel as bl
from glyphmill.plans.sizing import fits, small_side
from glyphmill.operators.training import learn_merges
from glyphmill.session import written
from glyphmill.sources.tables import local_table

# Fixed values.
VOCAB_SIZE = 8192
CHEAP_TOKENS = 2


@dataclass(frozen=True)
class Bpe:
    """Merge rules in rank order, as (left id, right id); at most a vocabulary."""

    merges: tuple[tuple[int, int], ...]

    @property
    def size(self) -> int:
        return bl.FIRST_MERGE + len(self.merges)

    def token_bytes(self) -> list[bytes]:
        """Bytes of every id; special tokens spell their name."""
        out = [t.encode() for t in bl.SPECIAL_TOKENS]
        offsets = bl.byte_offsets()
        out += [bytes([b]) for b in sorted(range(256), key=offsets.__getitem__)]
        for left, right in self.merges:
            out.append(out[left] + out[right])
        return out

    def tokens(self) -> list[str]:
        """Every id as shown text."""
        shown = bl.byte_characters()
        plain = list(bl.SPECIAL_TOKENS)
        return plain + ["".join(shown[b] for b in t) for t in self.token_bytes()[len(plain):]]


# -- pre-tokens ---------------------------------------------------------------


def pretokenize(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, pos, pretoken)``, one row per pre-token."""
    return docs.select(key, F.posexplode(bl.pretokens(F.col(text))).alias("pos", "pretoken"))


def pretoken_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """Corpus-wide ``(pretoken, n)``; frequent pre-tokens are summed map-side.

    No pre-token holds a blank after another character, so texts are first cut
    there, and only the distinct pieces are cut by the pattern.
    """
    pieces = docs.select(F.explode(bl.pieces(F.col(text))).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
    return (
        pieces.select(F.explode(bl.pretokens(F.col("piece"))).alias("pretoken"), "n")
        .groupBy("pretoken")
        .agg(F.sum("n").alias("n"))
    )


# -- training -----------------------------------------------------------------


def symbol_table(freq: DataFrame) -> DataFrame:
    """Distinct pre-tokens as ``(symbols, n)``."""
    return freq.select(bl.symbols(F.col("pretoken")).alias("symbols"), "n")


def pair_counts(table: DataFrame) -> DataFrame:
    """Weighted counts of adjacent symbol pairs ``(left, right, n)``."""
    ids = bl.symbol_ids(F.col("symbols"))
    return (
        table.filter(F.col("symbols").contains("  "))
        .select(ids.alias("ids"), "n")
        .select(
            F.explode(
                F.arrays_zip(
                    F.slice("ids", F.lit(1), F.size("ids") - 1).alias("left"),
                    F.slice("ids", F.lit(2), F.size("ids") - 1).alias("right"),
                )
            ).alias("pair"),
            "n",
        )
        .groupBy("pair.left", "pair.right")
        .agg(F.sum("n").alias("n"))
    )


def train_bpe(freq: DataFrame, vocab_size: int = VOCAB_SIZE, **limits: int) -> Bpe:
    """Learn merges from ``(pretoken, n)`` up to ``vocab_size`` entries.

    Pairs are ranked by count, then by the smaller ids, and merged one after
    the other; see ``training`` for how a round finds many merges at once and
    for ``limits``, which do not change the result.
    """
    rounds = learn_merges(freq, vocab_size - bl.FIRST_MERGE, **limits)
    return Bpe(tuple(merge for merges in rounds for merge in merges))


# -- vocabulary tables --------------------------------------------------------


def vocab_tables(spark: SparkSession, bpe: Bpe) -> tuple[DataFrame, DataFrame]:
    """``vocab(token, id, kind)`` and ``merges(rank, left, right, merged)``."""
    tokens = bpe.tokens()
    kinds = ["special"] * bl.FIRST_BYTE + ["byte"] * 256 + ["merge"] * len(bpe.merges)
    vocab = local_table(
        spark,
        [(t, i, k) for i, (t, k) in enumerate(zip(tokens, kinds))],
        "token string, id int, kind string",
    )
    merges = local_table(
        spark,
        [
            (rank, tokens[a], tokens[b], tokens[bl.FIRST_MERGE + rank])
            for rank, (a, b) in enumerate(bpe.merges)
        ],
        "rank int, left string, right string, merged string",
    )
    return vocab, merges


def bpe_from_tables(vocab: DataFrame, merges: DataFrame, ceiling: int = 65_536) -> Bpe:
    """Read the rules back from saved tables; tables over ``ceiling`` rows or with gaps raise an error."""
    for name, table in (("vocab", vocab), ("merges", merges)):
        if not fits(table, ceiling):
            raise ValueError(f"{name} has over {ceiling} rows; pass a larger ceiling")
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    rules = merges.orderBy("rank").collect()
    if [r["rank"] for r in rules] != list(range(len(rules))):
        raise ValueError("merge ranks are not 0, 1, 2, ...")
    return Bpe(tuple((ids[r["left"]], ids[r["right"]]) for r in rules))


# -- encode / decode ----------------------------------------------------------


def _merge_word(ids: list[int], ranks: dict[tuple[int, int], int]) -> list[int]:
    """Apply the lowest-ranked pair, leftmost first, until none applies.

    Symbols form a linked list and pairs a heap, so a long pre-token costs
    n log n; an entry whose pair has changed since is skipped.
    """
    after = [*range(1, len(ids)), -1]
    before = list(range(-1, len(ids) - 1))
    ids, gone = list(ids), -1
    heap = [(ranks[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if ids[i] == gone or j < 0 or ranks.get((ids[i], ids[j])) != rank:
            continue
        ids[i], ids[j] = bl.FIRST_MERGE + rank, gone
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right >= 0 and (ids[left], ids[right]) in ranks:
                heapq.heappush(heap, (ranks[ids[left], ids[right]], left))
    return [x for x in ids if x != gone]


# An odd number whose multiples spread over all 64 bits.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class _Ranks:
    """The rank of a pair of ids, looked up for whole arrays in an open hash table."""

    def __init__(self, merges: Sequence[tuple[int, int]]):
        self.none = len(merges)
        bits = max(8, (8 * len(merges)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.ranks = np.full(self.mask + 1, self.none, np.int32)
        self.probes = 1
        for rank, (left, right) in enumerate(merges):
            key = left << 32 | right
            at = int(self._first(np.array([key]))[0])
            probe = 1
            while self.keys[at] not in (-1, key):
                at, probe = (at + 1) & self.mask, probe + 1
            # A pair named twice has its last rank, as in a dictionary.
            self.keys[at], self.ranks[at], self.probes = key, rank, max(self.probes, probe)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _SPREAD) >> self.shift).view(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        at = self._first(keys)
        out = np.where(self.keys[at] == keys, self.ranks[at], self.none)
        for _ in range(self.probes - 1):
            at = (at + 1) & self.mask
            out = np.where(self.keys[at] == keys, self.ranks[at], out)
        return out


# The arrays of a round are several times the words' bytes.
WORDS_AT_ONCE = 32_768
# Words of more bytes are merged one by one, where a heap keeps their cost low.
LONG_WORD = 64
# Id 0 is a special token and in no merge: it ends every word.
_END = 0


def _merge_words(flat: np.ndarray, sizes: np.ndarray, ranks: _Ranks) -> tuple[np.ndarray, np.ndarray]:
    """``_merge_word`` of many words at once: their ids and sizes, one word after the other, before and after.

    A round merges every word's lowest-ranked pair wherever it stands, leftmost
    first; merges make no pair of a lower rank.  Words without a pair leave.
    """
    out: list[np.ndarray] = []
    names: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    word, n = np.flatnonzero(sizes), sizes[sizes > 0]
    live = np.full(len(flat) + len(word), _END, np.int32)
    live[np.arange(len(flat)) + np.repeat(np.arange(len(word)), n)] = flat
    while len(word):
        starts = np.concatenate([[0], np.cumsum(n + 1)[:-1]])
        found = np.append(ranks(live[:-1], live[1:]), ranks.none)
        lowest = np.minimum.reduceat(found, starts)
        going = lowest < ranks.none
        spans = np.repeat(going, n + 1)
        if not going.all():
            out.append(live[~spans & (live != _END)])
            names.append(word[~going])
            counts.append(n[~going])
            live, found, word, n, lowest = live[spans], found[spans], word[going], n[going], lowest[going]
        of = np.repeat(np.arange(len(word)), n + 1)
        hit = np.flatnonzero(found == lowest[of])
        if not len(hit):
            break
        # Of neighbouring hits, which are pairs of one id with itself, every second one overlaps the one before it.
        first = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
        hit = hit[(np.arange(len(hit)) - np.repeat(first, np.diff(np.append(first, len(hit))))) % 2 == 0]
        live[hit] = bl.FIRST_MERGE + found[hit]
        keep = np.ones(len(live), bool)
        keep[hit + 1] = False
        n = n - np.bincount(of[hit], minlength=len(word))
        live = live[keep]
    size = np.zeros(len(sizes), np.int64)
    if not names:
        return np.zeros(0, np.int32), size
    name, count = np.concatenate(names), np.concatenate(counts)
    size[name] = count
    # Every word's ids go to where the word begins.
    begin = (np.cumsum(size) - size)[name]
    merged = np.empty(int(count.sum()), np.int32)
    merged[np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(len(merged))] = np.concatenate(out)
    return merged, size


def _word_ids(words: pa.Array, bpe: Bpe, ranks: _Ranks, specials: bool) -> pa.Array:
    """Ids of distinct pre-tokens."""
    first = np.array([bl.FIRST_BYTE + o for o in bl.byte_offsets()], np.int32)
    coded = words.cast(pa.large_binary())
    offsets = np.frombuffer(coded.buffers()[1], np.int64)[coded.offset : coded.offset + len(coded) + 1]
    data = coded.buffers()[2]
    flat = first[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data else np.zeros(0, np.int32)
    sizes = np.diff(offsets)
    fixed = {name: [i] for i, name in enumerate(bl.SPECIAL_TOKENS)} if specials else {}
    alone = sizes > LONG_WORD
    if fixed:
        alone |= pc.is_in(words, value_set=pa.array(list(fixed))).to_numpy(zero_copy_only=False)
    one = np.flatnonzero(alone)
    by_pair = {pair: rank for rank, pair in enumerate(bpe.merges)} if len(one) else {}
    others = [
        fixed.get(words[int(k)].as_py())
        or _merge_word(flat[offsets[k] - offsets[0] : offsets[k + 1] - offsets[0]].tolist(), by_pair)
        for k in one
    ]
    short, counts = flat[~np.repeat(alone, sizes)], np.where(alone, 0, sizes)
    at = np.concatenate([[0], np.cumsum(counts)])
    some = [slice(a, min(a + WORDS_AT_ONCE, len(counts))) for a in range(0, len(counts), WORDS_AT_ONCE)]
    done = [_merge_words(short[at[w.start] : at[w.stop]], counts[w], ranks) for w in some]
    merged = np.concatenate([np.zeros(0, np.int32), *(ids for ids, _ in done)])
    size = np.concatenate([np.zeros(0, np.int64), *(n for _, n in done)])
    size[one] = [len(ids) for ids in others]
    ends = np.concatenate([[0], np.cumsum(size)])
    ids = np.empty(ends[-1], np.int32)
    plain = np.ones(len(ids), bool)
    for k, own in zip(one, others):
        ids[ends[k] : ends[k + 1]], plain[ends[k] : ends[k + 1]] = own, False
    ids[plain] = merged
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))


def _gathered(words: pa.Array, bpe: Bpe, ranks: _Ranks, specials: bool) -> pa.Array:
    """The ids of lists of pre-tokens, each distinct one merged once."""
    flat = words.flatten().dictionary_encode()
    return _listed_ids(words, flat.indices, _word_ids(flat.dictionary, bpe, ranks, specials))


def _listed_ids(words: pa.Array, indices: pa.Array, per_word: pa.Array) -> pa.Array:
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    taken = per_word.take(indices)
    sizes = pc.list_value_length(taken).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)])[ends].astype("int32")
    mask = words.is_null() if words.null_count else None
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), taken.flatten(), mask=mask)


def encode(text: Column, bpe: Bpe, specials: bool = True) -> Column:
    """Token ids of a text, ``array<int>``; null stays null.

    A special token's name inside the text becomes its one id; without
    ``specials`` it is cut into pieces like any other text.

    Pre-tokens are cut in the JVM.  Each Arrow batch is dictionary-encoded, its
    distinct pre-tokens are merged all at once by array operations, and the ids
    are gathered by array operations as well.
    """
    ranks = _Ranks(bpe.merges)

    @F.arrow_udf("array<int>")
    def ids_of(words: pa.Array) -> pa.Array:
        return _gathered(words, bpe, ranks, specials)

    return ids_of(bl.pretokens(text, specials))


def encode_both(text: Column, bpe: Bpe, plain: Bpe) -> Column:
    """``struct<ids, plain_ids>``: ``encode`` by ``bpe``, and by ``plain`` without special tokens.

    A text is cut and sent to Python once for both, unless it may name a special token.
    """
    ranks, plain_ranks = _Ranks(bpe.merges), _Ranks(plain.merges)

    @F.arrow_udf("struct<ids: array<int>, plain_ids: array<int>>")
    def both(words: pa.Array, cut_alike: pa.Array) -> pa.Array:
        flat = words.flatten().dictionary_encode()
        ids = _listed_ids(words, flat.indices, _word_ids(flat.dictionary, bpe, ranks, True))
        if cut_alike.null_count < len(cut_alike):
            other = pc.if_else(cut_alike.is_null(), words, cut_alike)
            plain_ids = _gathered(other, plain, plain_ranks, False)
        else:
            plain_ids = _listed_ids(words, flat.indices, _word_ids(flat.dictionary, plain, plain_ranks, False))
        # A worker that waits keeps no memory of the batch before.
        pa.default_memory_pool().release_unused()
        return pa.StructArray.from_arrays([ids, plain_ids], names=["ids", "plain_ids"])

    named = F.contains(text, F.lit("<|"))
    return both(bl.pretokens(text, True), F.when(named, bl.pretokens(text, False)))


def _texts(values: Sequence[str]) -> Column:
    """A constant array, folded once when the query is planned."""
    return F.split(F.lit("\n".join(values)), "\n")


def token_bytes(ids: Column, bpe: Bpe) -> Column:
    """How many bytes the ordinary tokens of an id list stand for."""
    sizes = _texts([str(len(t)) for t in bpe.token_bytes()]).cast("array<int>")
    plain = F.filter(ids, lambda i: i >= bl.FIRST_BYTE)
    return F.aggregate(plain, F.lit(0).cast("bigint"), lambda n, i: n + F.element_at(sizes, i + 1))


def token_count(text: Column, bpe: Bpe) -> Column:
    return F.size(encode(text, bpe)).cast("bigint")


def decode(ids: Column, bpe: Bpe, skip_special: bool = True) -> Column:
    """Text of token ids.

    The vocabulary travels as one literal array of hex strings; bytes are
    joined before they are read as UTF-8, since a token may end inside a
    character.
    """
    table = _texts([t.hex() for t in bpe.token_bytes()])
    kept = F.filter(ids, lambda i: i >= bl.FIRST_BYTE) if skip_special else ids
    digits = F.array_join(F.transform(kept, lambda i: F.element_at(table, i + 1)), "")
    return F.make_valid_utf8(F.unhex(digits).cast("string"))


def token_strings(ids: Column, bpe: Bpe) -> Column:
    """Ids as the vocabulary shows them."""
    table = _texts(bpe.tokens())
    return F.transform(ids, lambda i: F.element_at(table, i + 1))


# -- reports ------------------------------------------------------------------


def filter_by_cost(words: DataFrame, bpe: Bpe, k: int = CHEAP_TOKENS, column: str = "word") -> DataFrame:
    """Keep words that cost at most ``k`` tokens after a blank.

    The cost is filtered inside an array: as a condition it would be pushed down
    below a distinct, to every occurrence of a word.
    """
    costed = words.select("*", token_count(F.concat(F.lit(" "), F.col(column)), bpe).alias("_cost"))
    cheap = F.filter(F.array("_cost"), lambda cost: cost <= k)
    return costed.select("*", F.explode(cheap).alias("_cheap")).select(*words.columns)


def token_cost(probes: DataFrame, bpe: Bpe) -> DataFrame:
    """Per group of probe strings: count, mean and largest token cost."""
    cost = token_count(F.concat(F.lit(" "), F.col("probe")), bpe)
    return (
        probes.withColumn("cost", cost)
        .groupBy("grp")
        .agg(
            F.count("*").alias("n_probes"),
            F.round(F.avg("cost"), 6).alias("mean_cost"),
            F.max("cost").alias("max_cost"),
        )
    )


def vocab_fit(words: DataFrame, bpe: Bpe, k: int = CHEAP_TOKENS) -> DataFrame:
    """``(kind, word, cost, cheap)``: which words the tokenizer handles cheaply."""
    cost = token_count(F.concat(F.lit(" "), F.col("word")), bpe)
    return words.select("kind", "word", cost.alias("cost")).withColumn("cheap", F.col("cost") <= k)


def vocab_fit_report(fit: DataFrame) -> DataFrame:
    """Every word with its cost and whether it is cheap, and what its kind and all words come to.

    Beside ``kind, word, cost, cheap``: ``n_words`` of the kind at that cost and the kind's ``cheap_share``;
    of all kinds, ``all_at_cost``, ``all_cheap``, ``all_costly`` and ``all_cheap_share``.  The costly rows are
    the words to drop.  The costs are written for the passes over them, so no word is tokenized twice.
    """
    fit = written(fit, "word-costs")
    hist = fit.groupBy("kind", "cost").agg(
        F.count("*").alias("n_words"), F.sum(F.col("cheap").cast("int")).alias("n_cheap")
    )
    hist = written(hist, "cost-counts")
    share = hist.groupBy("kind").agg(
        F.round(F.sum("n_cheap") / F.sum("n_words"), 6).alias("cheap_share")
    )
    at_cost = hist.groupBy("cost").agg(F.sum("n_words").alias("all_at_cost"))
    total = hist.agg(
        F.coalesce(F.sum("n_cheap"), F.lit(0)).alias("cheap"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words")
    ).first()
    counts = small_side(hist.select("kind", "cost", "n_words").join(share, "kind").join(at_cost, "cost"))
    return fit.join(counts, ["kind", "cost"]).select(
        "kind",
        "word",
        "cost",
        "cheap",
        "n_words",
        "cheap_share",
        "all_at_cost",
        F.lit(total["cheap"]).cast("bigint").alias("all_cheap"),
        F.lit(total["words"] - total["cheap"]).cast("bigint").alias("all_costly"),
        F.round(F.try_divide(F.lit(total["cheap"]), F.lit(total["words"])), 6).alias("all_cheap_share"),
    )


def cheap_pairs(fit: DataFrame, bpe: Bpe, n: int = 6) -> DataFrame:
    """Two-word labels of the k-th cheap word and the k-th from the end.

    Only the first and last ``n`` cheap words in (kind, word) order matter, so
    each task keeps its own top ``n`` from either end.  The cheap words are kept
    for the three passes, so none is tokenized twice.
    """
    cheap = fit.filter("cheap").select("kind", "word").persist(StorageLevel.MEMORY_AND_DISK)
    total = cheap.agg(F.count("*").alias("n")).first()["n"]
    keep = min(n, total // 2) if total >= 4 else 0

    def end(descending: bool, name: str) -> DataFrame:
        order = [F.desc(c) if descending else F.asc(c) for c in ("kind", "word")]
        ends = cheap.orderBy(*order).limit(keep)
        # At most ``n`` rows, numbered in one small task.
        return ends.agg(F.collect_list(F.struct("kind", "word")).alias("ws")).select(
            F.posexplode(F.sort_array("ws", asc=not descending)).alias("k", "w")
        ).select("k", F.col("w.word").alias(name))

    label = F.concat_ws(" ", "head", "tail")
    return (
        end(False, "head")
        .join(end(True, "tail"), "k")
        .select((F.col("k") + 1).cast("bigint").alias("k"), label.alias("label"))
        .withColumn("cost", token_count(F.concat(F.lit(" "), F.col("label")), bpe))
    )


def token_conservation(encoded: DataFrame, bpe: Bpe, ids: str = "ids", totals: str | None = None) -> DataFrame:
    """Documents, bytes of text their tokens stand for, and end-of-text ids per split.

    ``totals`` names another column of ids whose number and two-byte storage are added.
    """
    more = [F.sum(F.size(totals)).alias(f"n_{totals}"), (F.sum(F.size(totals)) * 2).alias("n_bytes")] if totals else []
    return encoded.groupBy("split").agg(
        F.count("*").alias("n_docs"),
        F.sum(token_bytes(F.col(ids), bpe)).alias("text_bytes"),
        F.sum(F.size(F.filter(ids, lambda i: i == bl.EOT))).alias("n_ends"),
        *more,
    )


def token_totals(encoded: DataFrame, ids: str = "ids") -> DataFrame:
    """Documents, tokens and two-byte storage per split."""
    return encoded.groupBy("split").agg(
        F.count("*").alias("n_docs"),
        F.sum(F.size(ids)).alias("n_tokens"),
        (F.sum(F.size(ids)) * 2).alias("n_bytes"),
    )


def check_vocab(blocks: DataFrame, bpe_size: int, declared: int, tokens: str = "tokens") -> DataFrame:
    """Compare the tokenizer with a declared model vocabulary."""
    found = blocks.agg(F.max(F.array_max(tokens)).cast("bigint").alias("max_id"))
    size = F.lit(bpe_size).cast("bigint")
    return found.select(
        size.alias("tokenizer_size"),
        F.lit(declared).cast("bigint").alias("declared_size"),
        "max_id",
        F.when((size > declared) | (F.col("max_id") >= declared), "error")
        .when(size < declared, "unused_rows")
        .otherwise("ok")
        .alias("verdict"),
    )


def prefix_audit(df: DataFrame, bpe: Bpe, prefix: str = "prefix", full: str = "full") -> DataFrame:
    """Are a prefix's ids also a prefix of the full text's ids?"""
    ids = df.withColumn("_p", encode(F.col(prefix), bpe)).withColumn("_f", encode(F.col(full), bpe))
    same = F.slice("_f", F.lit(1), F.size("_p")) == F.col("_p")
    return ids.withColumn("agrees", same).drop("_p", "_f")

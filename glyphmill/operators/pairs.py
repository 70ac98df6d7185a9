"""Pair generation: slots, novel spans, rendering, distinct pairs, axis sets."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import draw
from glyphmill.functions import text as tx
from glyphmill.operators import lexicon, paraphrase
from glyphmill.plans.sizing import dealt, global_rank, small_side
from glyphmill.session import written
from glyphmill.sources.tables import local_table

# Fixed values.
PAIR_SEED = 42
VAL_SHARE = 0.15
NOVEL_SHARE = {"train": 0.0, "val": 0.5}
STREAM_NOVEL_SHARE = 0.2
WORD_CUT = 14
AXES = {
    "control": ("train", "train", 11),
    "values": ("val", "train", 22),
    "phrasing": ("train", "val", 33),
    "both": ("val", "val", 44),
}
MAX_VOCABULARY = 65_536

# A pool counted at up to this many values is read from constant lists; a larger one is joined by position.
LISTED_VALUES = 20_000
_LINE = "\n"

# The virtual machine never compiles a longer method; Spark then splits a stage's code instead.
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
COMPILED_BYTES = 8000

PAIR_SCHEMA = (
    "pair_id bigint, split string, shape string, prompt string, diagram string, "
    "slots map<string,string>, novel boolean"
)


Seed = int | Column


@dataclass(frozen=True)
class PairKit:
    """What sampling needs: the indexed tables and their sizes."""

    shapes: DataFrame  # shape_at, shape, pattern, n_train, n_val (phrases), slot_list
    pool: DataFrame  # category, split, idx, value
    phrases: DataFrame  # shape, split, idx, paraphrase
    n_shapes: int
    pool_sizes: dict[tuple[str, str], int]
    n_phrases: int
    fragments: tuple[str, ...]
    n_slots: int  # most slots of a shape
    listed: dict[tuple[str, str], tuple[str, ...]] | None = None  # values by position, of a small pool

    @property
    def categories(self) -> list[str]:
        return sorted({category for category, _ in self.pool_sizes})


def build_kit(
    words: DataFrame,
    tables: dict[str, DataFrame],
    fragments: DataFrame | None = None,
) -> PairKit:
    """Pools, paraphrases and their sizes from a word table and a grammar.

    The sizes (one number per category, shape and split) come to the driver;
    the tables stay distributed and cached.
    """
    words.sparkSession.conf.set(METHOD_LIMIT, str(COMPILED_BYTES))
    words = words.cache()
    lexicon.require_words(words)
    pool = lexicon.split_pools(lexicon.label_pools(words)).cache()
    phrases = paraphrase.split_paraphrases(
        paraphrase.expand(tables["frames"], tables["connectives"])
    ).cache()
    slot_list = F.transform(
        tx.slot_names(F.col("pattern")),
        lambda s: F.struct(
            s.alias("name"),
            tx.slot_category(s).alias("category"),
            (F.regexp_extract(s, "([0-9]+)$", 1).cast("bigint") - 1).alias("k"),
        ),
    )
    phrase_sizes = _sizes(phrases, "shape")
    patterns = sorted(tuple(r) for r in tables["shapes"].select("shape", "pattern").collect())
    shapes = local_table(
        words.sparkSession,
        [
            (i, shape, pattern, phrase_sizes.get((shape, "train"), 0), phrase_sizes.get((shape, "val"), 0))
            for i, (shape, pattern) in enumerate(patterns)
        ],
        "shape_at bigint, shape string, pattern string, n_train bigint, n_val bigint",
    ).withColumn("slot_list", slot_list)
    pieces = (fragments if fragments is not None else tables["fragments"]).select("fragment")
    rows = pieces.orderBy("fragment").limit(MAX_VOCABULARY + 1).collect()
    if len(rows) > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary holds at most {MAX_VOCABULARY} fragments")
    pool_sizes = _sizes(pool, "category")
    return PairKit(
        shapes=shapes,
        pool=pool,
        phrases=phrases,
        n_shapes=len(patterns),
        pool_sizes=pool_sizes,
        n_phrases=sum(phrase_sizes.values()),
        fragments=tuple(r["fragment"] for r in rows),
        n_slots=max(len(set(re.findall(tx.SLOT_HOLE, pattern))) for _, pattern in patterns),
        listed=_listed(pool, pool_sizes),
    )


def _listed(pool: DataFrame, sizes: dict[tuple[str, str], int]) -> dict[tuple[str, str], tuple[str, ...]] | None:
    """The values of a pool counted as small, per (category, side) in the order of their dense positions."""
    if sum(sizes.values()) > LISTED_VALUES:
        return None
    lists: dict[tuple[str, str], list[str]] = {side: [] for side in sizes}
    for r in pool.orderBy("category", "split", "idx").collect():
        lists[r["category"], r["split"]].append(r["value"])
    # A value with a line break cannot stand in a list of lines.
    broken = any(_LINE in value for values in lists.values() for value in values)
    return None if broken else {side: tuple(values) for side, values in lists.items()}


def _sizes(indexed: DataFrame, name: str) -> dict[tuple[str, str], int]:
    counts = indexed.groupBy(name, "split").agg(F.count("*").alias("n")).collect()
    return {(r[name], r["split"]): r["n"] for r in counts}


def draw_shape(keys: DataFrame, kit: PairKit, seed: Seed = PAIR_SEED) -> DataFrame:
    """Give each key a shape: adds ``shape, pattern, n_train, n_val, slot_list``."""
    h = draw.digest(seed, F.col("pair_id"), "shape")
    return (
        keys.withColumn("shape_at", draw.pick(h, kit.n_shapes))
        .join(F.broadcast(kit.shapes), "shape_at")
        .drop("shape_at")
    )


def _per_split(sizes: dict[tuple[str, str], int], category: str, split: Column) -> Column:
    out = F.lit(0).cast("bigint")
    for (name, side), n in sorted(sizes.items()):
        if name == category:
            out = F.when(split == side, F.lit(n).cast("bigint")).otherwise(out)
    return out


def with_draws(df: DataFrame, kit: PairKit, seed: Seed) -> DataFrame:
    """Add ``_draw_<category> struct<base, step, size, second>`` per category.

    Drawn once per row, outside the per-slot lambda, in generated code.
    """
    for category in kit.categories:
        h = draw.digest(seed, F.col("pair_id"), category)
        size = _per_split(kit.pool_sizes, category, F.col("value_split"))
        df = df.withColumn("_h", h).withColumn("_size", size)
        step = 1 + draw.window(F.col("_h"), 1) % F.greatest(
            F.lit(1).cast("bigint"), F.floor((F.col("_size") - 1) / 4).cast("bigint")
        )
        df = df.withColumn(
            f"_draw_{category}",
            F.struct(
                draw.window(F.col("_h"), 0).alias("base"),
                step.alias("step"),
                F.col("_size").alias("size"),
                draw.window(F.col("_h"), 2).alias("second"),
            ),
        ).drop("_h", "_size")
    return df


def pool_index(category: str, k: Column) -> Column:
    """Pool position of the ``k``-th slot of a category.

    Open categories take ``base + step * k`` with a step below a quarter of the
    pool: up to four draws of one sample never meet, so there is nothing to
    redraw.  Closed categories draw independently and may repeat.
    """
    d = F.col(f"_draw_{category}")
    if category in lexicon.CLOSED_CATEGORIES:
        return F.when(k == 0, d["base"]).otherwise(d["second"]) % d["size"]
    return (d["base"] + d["step"] * k) % d["size"]


def _by_category(kit: PairKit, category: Column, value) -> Column:
    out = None
    for name in kit.categories:
        hit = category == name
        out = F.when(hit, value(name)) if out is None else out.when(hit, value(name))
    return out


def novel_value(key: Column, slot: Column, fragments: tuple[str, ...], seed: Seed = PAIR_SEED) -> Column:
    """An invented label: one or two capitalised words of one to three fragments."""
    pieces = F.split(F.lit(",".join(fragments)), ",")
    n = len(fragments)

    def hashed(role: str) -> Column:
        own = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
        return F.md5(F.concat_ws("|", own, key.cast("string"), slot, F.lit(role)).cast("binary"))

    def word(h: Column) -> Column:
        at = [F.element_at(pieces, (draw.pick(h, n, i + 1) + 1).cast("int")) for i in range(3)]
        # One fragment (1 in 4), two (2 in 4) or three (1 in 4).
        used = F.floor((draw.pick(h, 4) + 3) / 2).cast("int")
        return F.initcap(F.substring(F.array_join(F.slice(F.array(*at), F.lit(1), used), ""), 1, WORD_CUT))

    single = draw.pick(hashed("words"), 3) == 0
    hashes = F.when(single, F.array(hashed("word1"))).otherwise(F.array(hashed("word1"), hashed("word2")))
    return F.array_join(F.transform(hashes, word), " ")


def _closed(category: Column) -> Column:
    return category.isin(*lexicon.CLOSED_CATEGORIES)


def sample_slots(df: DataFrame, kit: PairKit, seed: Seed = PAIR_SEED) -> DataFrame:
    """Add ``slots map<slot, value>``: pool values, or invented ones if ``novel``.

    ``df`` holds ``pair_id, value_split, novel, slot_list``.  Rows are neither
    exploded nor regrouped, so repeated keys and streams are served alike.
    Closed categories always draw from the pool.
    """
    invented = F.transform(
        "slot_list",
        lambda s: F.when(~_closed(s["category"]), novel_value(F.col("pair_id"), s["name"], kit.fragments, seed)),
    )
    invented = F.when(F.col("novel"), invented)
    drawn = with_draws(df, kit, seed)
    drawn = drawn if kit.listed else _joined_values(drawn, kit)
    values = []
    for i in range(kit.n_slots):
        slot = F.get("slot_list", F.lit(i))
        pooled = _listed_value(kit, slot) if kit.listed else F.col(f"_pooled_{i}")
        opened = F.col("novel") & ~_closed(slot["category"])
        values.append(F.when(opened, F.get(F.col("_invented"), F.lit(i))).otherwise(pooled))
    held = F.slice(F.array(*values), F.lit(1), F.size("slot_list"))
    slots = F.map_from_arrays(F.col("slot_list")["name"], held)
    return drawn.withColumn("_invented", invented).withColumn("slots", slots).select(*df.columns, "slots")


def _listed_value(kit: PairKit, slot: Column) -> Column:
    """The pool value of a slot, read out of the constant list of its (category, side): no join."""

    def of_category(category: str) -> Column:
        own = None
        for (name, side), values in sorted(kit.listed.items()):
            if name == category:
                # One constant, folded once when the query is planned.
                value = F.get(F.split(F.lit(_LINE.join(values)), _LINE), pool_index(category, slot["k"]).cast("int"))
                hit = F.col("value_split") == side
                own = F.when(hit, value) if own is None else own.when(hit, value)
        return own

    return _by_category(kit, slot["category"], of_category)


def _joined_values(drawn: DataFrame, kit: PairKit) -> DataFrame:
    """Add the pool value of every slot position, ``_pooled_<i>``, from a pool of any size.

    Each position (a shape has a handful) is one lookup join on (category, side,
    position); a pool counted as small is broadcast once.
    """
    pool = small_side(
        kit.pool.select(
            F.col("category").alias("_category"),
            F.col("split").alias("_side"),
            F.col("idx").alias("_idx"),
            F.col("value").alias("_pooled"),
        ),
        rows=sum(kit.pool_sizes.values()),
    )
    for i in range(kit.n_slots):
        slot = F.get("slot_list", F.lit(i))
        at = _by_category(kit, slot["category"], lambda c: pool_index(c, slot["k"]))  # noqa: B023
        placed = drawn.withColumns({"_wanted": slot["category"], "_at": at})
        here = (
            (F.col("_wanted") == F.col("_category"))
            & (F.col("value_split") == F.col("_side"))
            & (F.col("_at") == F.col("_idx"))
        )
        drawn = placed.join(pool, here, "left").withColumnRenamed("_pooled", f"_pooled_{i}")
        drawn = drawn.drop("_wanted", "_at", "_category", "_side", "_idx")
    return drawn


def draw_phrase(df: DataFrame, kit: PairKit, seed: Seed = PAIR_SEED) -> DataFrame:
    """Add the paraphrase drawn for each key from its shape's phrases.

    ``phrase_split`` is train, val or any; any draws from both sides.
    """
    wanted = F.col("phrase_split")
    size = (
        F.when(wanted == "train", F.col("n_train"))
        .when(wanted == "val", F.col("n_val"))
        .otherwise(F.col("n_train") + F.col("n_val"))
    )
    later = (wanted == "any") & (F.col("_draw") >= F.col("n_train"))
    phrases = small_side(
        kit.phrases.select(
            "shape", F.col("split").alias("_side"), F.col("idx").alias("_at"), "paraphrase"
        ),
        rows=kit.n_phrases,
    )
    return (
        df.withColumn("_draw", draw.pick(draw.digest(seed, F.col("pair_id"), "phrase"), size))
        .withColumn("_side", F.when((wanted == "val") | later, "val").otherwise("train"))
        .withColumn("_at", F.when(later, F.col("_draw") - F.col("n_train")).otherwise(F.col("_draw")))
        .join(phrases, ["shape", "_side", "_at"])
        .drop("_draw", "_at", "_side")
    )


def render(df: DataFrame) -> DataFrame:
    """Fill ``paraphrase`` and ``pattern`` from ``slots``: adds ``prompt, diagram``."""
    return df.withColumn("prompt", tx.fill_holes(F.col("paraphrase"), F.col("slots"))).withColumn(
        "diagram", tx.fill_holes(F.col("pattern"), F.col("slots"))
    )


def draw_pairs(keys: DataFrame, kit: PairKit, seed: Seed = PAIR_SEED) -> DataFrame:
    """One rendered pair per key; no row moves while the lookups are small.

    ``keys`` holds ``pair_id, value_split, phrase_split, novel`` and whatever
    else the caller wants to keep.
    """
    drawn = sample_slots(draw_shape(keys, kit, seed), kit, seed)
    return render(draw_phrase(drawn, kit, seed)).drop(
        "pattern", "paraphrase", "n_train", "n_val", "slot_list", "value_split", "phrase_split"
    )


def split_keys(
    ids: DataFrame,
    seed: Seed = PAIR_SEED,
    val_share: float = VAL_SHARE,
    novel_share: dict[str, float] | None = None,
    hold_out_phrases: bool = True,
) -> DataFrame:
    """Keys with a train / val side and a novel flag, both drawn from the key.

    Val pairs use held-out phrases, or any phrase if ``hold_out_phrases`` is off.
    """
    shares = novel_share or NOVEL_SHARE
    h = draw.digest(seed, F.col("pair_id"), "side")
    split = F.when(draw.below(h, val_share), F.lit("val")).otherwise(F.lit("train"))
    return ids.withColumn("split", split).select(
        *ids.columns,
        "split",
        F.col("split").alias("value_split"),
        F.when((F.col("split") == "val") & F.lit(not hold_out_phrases), F.lit("any"))
        .otherwise(F.col("split"))
        .alias("phrase_split"),
        F.when(F.col("split") == "val", draw.below(h, shares["val"], 1))
        .otherwise(draw.below(h, shares["train"], 1))
        .alias("novel"),
    )


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """Keep the pair with the smallest id of each (split, prompt, diagram).

    An aggregate rather than a ranking window: copies are dropped map-side, so a
    pair repeated by a third of all keys reaches the shuffle once per task.
    """
    rest = [c for c in ("shape", "slots", "novel") if c in pairs.columns]
    return (
        pairs.groupBy("split", "prompt", "diagram")
        .agg(F.min("pair_id").alias("pair_id"), F.min_by(F.struct(*rest), "pair_id").alias("_rest"))
        .select("pair_id", "split", "_rest.shape", "prompt", "diagram", "_rest.slots", "_rest.novel")
    )


def generate_pairs(
    ids: DataFrame,
    kit: PairKit,
    seed: Seed = PAIR_SEED,
    novel_share: dict[str, float] | None = None,
    n: int | None = None,
    hold_out_phrases: bool = True,
    side: str | None = None,
) -> DataFrame:
    """Distinct (prompt, diagram) pairs of a column of keys ``pair_id``.

    The key range sets the size; ``n`` takes the first pairs by id; ``side``
    draws one split only, which no pair of the other can change.  Every key
    is drawn once, into a written table.  Only 128-bit digests of the texts are
    grouped, and the keys that lose against a smaller one, which are few, are
    taken out of the table.
    """
    keys = split_keys(
        dealt(ids.select("pair_id"), "pair_id").distinct(), seed, novel_share=novel_share, hold_out_phrases=hold_out_phrases
    )
    keys = keys if side is None else keys.filter(F.col("split") == side)
    text = ("prompt", "diagram")
    made = draw_pairs(keys, kit, seed).select(
        "pair_id",
        "split",
        "shape",
        *text,
        "slots",
        "novel",
        F.xxhash64(*text).alias("_a"),
        F.xxhash64(F.lit("second"), *text).alias("_b"),
    )
    made = written(made, "drawn-pairs")
    mark = ["split", "_a", "_b"]
    groups = made.groupBy(*mark).agg(F.min("pair_id").alias("_first"), F.count("*").alias("_copies"))
    repeated = written(groups.filter("_copies > 1").drop("_copies"), "repeated-pairs")
    losers = made.select("pair_id", *mark).join(small_side(repeated), mark).filter("pair_id > _first").select("pair_id")
    losers = small_side(written(losers, "repeated-keys"))
    pairs = made.drop("_a", "_b").join(losers, "pair_id", "left_anti")
    return pairs if n is None else pairs.orderBy("pair_id").limit(n)


def axis_sets(ids: DataFrame, kit: PairKit, n: int | None = None) -> DataFrame:
    """Four evaluation sets: {seen, new} values x {seen, new} phrasing.

    Every key yields one pair per axis; each axis draws with its own seed.
    ``n`` keeps the first keys by id, per axis.
    """
    base = ids if n is None else ids.orderBy("pair_id").limit(n)
    axes = F.array(
        *[
            F.struct(
                F.lit(axis).alias("axis"),
                F.lit(values).alias("value_split"),
                F.lit(phrases).alias("phrase_split"),
                F.lit(seed).alias("axis_seed"),
            )
            for axis, (values, phrases, seed) in AXES.items()
        ]
    )
    keys = base.select("pair_id", F.explode(axes).alias("a")).select(
        "pair_id", "a.*", F.lit(False).alias("novel")
    )
    return draw_pairs(keys, kit, F.col("axis_seed")).drop("axis_seed")


def pair_mix_report(pairs: DataFrame) -> DataFrame:
    """Pairs and novel pairs per split and shape, with subtotals (``ALL``)."""
    return (
        pairs.cube("split", "shape")
        .agg(
            F.count("*").alias("n_pairs"),
            F.sum(F.col("novel").cast("int")).cast("bigint").alias("n_novel"),
        )
        .select(
            F.coalesce("split", F.lit("ALL")).alias("split"),
            F.coalesce("shape", F.lit("ALL")).alias("shape"),
            "n_pairs",
            "n_novel",
            F.round(F.col("n_novel") / F.col("n_pairs"), 6).alias("novel_share"),
        )
    )


def mixed_corpus(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """Tokenizer input: ``tokenizer_lines`` and documents as ``(origin, copy, line, text)``."""
    return lines.unionByName(
        docs.select(
            F.lit("documents").alias("origin"),
            F.lit(1).cast("bigint").alias("copy"),
            F.col("doc_id").cast("string").alias("line"),
            "text",
        )
    )


def tokenizer_lines(pool: DataFrame, pairs: DataFrame, chunk: int = 64, repeat: int = 5) -> DataFrame:
    """Text lines for tokenizer training: pool values in chunks, and pairs.

    Held-out values are included on purpose: the tokenizer learns how to cut
    strings, not which diagram answers which prompt.  Pairs are those of the
    training side only: no held-out phrasing and no novel span enters.
    """
    values = pool.select("category", "value").distinct()
    hashed = values.withColumn("_h", F.md5(F.col("value").cast("binary")))
    numbered = global_rank(hashed, ["category"], "_h", ["value"], "_at", "_n")
    chunks = (
        numbered.withColumn("chunk", F.floor(F.col("_at") / chunk).cast("bigint"))
        .groupBy("category", "chunk")
        .agg(F.array_sort(F.collect_list(F.struct("_at", "value"))).alias("items"))
        .select(
            F.concat_ws("/", "category", "chunk").alias("line"),
            F.array_join(F.transform("items", lambda i: i["value"]), " ").alias("text"),
        )
    )
    repeated = chunks.select(
        F.lit("values").alias("origin"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(repeat).cast("bigint"))).alias("copy"),
        "line",
        "text",
    )
    return repeated.unionByName(
        pairs.filter((F.col("split") == "train") & ~F.col("novel")).select(
            F.lit("pairs").alias("origin"),
            F.lit(1).cast("bigint").alias("copy"),
            F.col("pair_id").cast("string").alias("line"),
            F.concat_ws("\n", "prompt", "diagram").alias("text"),
        )
    )

"""Quality rule by distribution divergence.

A document's character classes and common words are two histograms.  Both are
compared with the reference of the document's language by Jensen-Shannon
distance; a document far from its language is not kept.  References are the
mean histograms of all documents of a language that pass the base rules and are
neither laden with symbols nor mostly capitals.  A short text strays from any
reference by chance, so the allowed distance is ``floor + noise / sqrt(length)``.

* Documents under ``min_chars`` / ``min_words`` are too short for the
  respective comparison and are judged by the base rules alone.
* A language with fewer than ``min_reference`` documents has no reference; its
  documents (also those with a null language, which is a language of its own)
  are judged by the base rules alone.
* A language without a word list is compared by character classes only.
* A null text is an empty one: zero words, so the base rules reject it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import SPACE_RUN, body, let, lookup, words

# Frequent function words of each language.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "it", "was", "for", "with"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "im", "für", "ist"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "est", "que"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "del", "las", "un", "para"),
}

# Character classes, removed from the text one after the other, so that only
# the first pattern reads the whole of it.
CLASSES = (
    ("lower", "[a-z]+"),
    ("space", SPACE_RUN),
    ("upper", "[A-Z]+"),
    ("digit", "[0-9]+"),
    ("letter", r"\p{L}+"),
    ("stop", "[.,]+"),
    ("symbol", "[#*$%&|<>]+"),
)


@dataclass(frozen=True)
class Rules:
    min_chars: int = 200
    min_words: int = 50
    min_reference: int = 20
    class_floor: float = 0.14
    class_noise: float = 2.0
    word_floor: float = 0.12
    word_noise: float = 1.8
    common_words: dict = field(default_factory=lambda: COMMON_WORDS)


def repeated_words(tokens: Column) -> Column:
    """Words inside three-word windows that occur at least twice.

    Windows are compared by a 64-bit hash.  Only texts with a repeated window
    pay for the sort that brings equal windows side by side.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(tokens) - 3),
        lambda i: F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2)),
    )

    def covered(grams: Column) -> Column:
        ordered = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeats(s: Column) -> Column:
            same = lambda x, j: F.coalesce(x["h"] == F.get(s, j)["h"], F.lit(False))
            twice = F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        total = F.aggregate(
            let(ordered, repeats),
            zero,
            lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n")),
        )["n"]
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(total)

    return F.when(F.size(tokens) < 3, F.lit(0)).otherwise(let(windows, covered)).cast("bigint")


def _common_counts(tokens: Column, rules: Rules) -> Column:
    """Counts of the language's common words, then of all other words; empty without a list."""
    known = sorted({w for ws in rules.common_words.values() for w in ws})
    listed = F.lit(None).cast("array<string>")
    for lang, ws in rules.common_words.items():
        listed = F.when(F.col("lang") == lang, F.array(*[F.lit(w) for w in ws])).otherwise(listed)
    found = F.transform(F.filter(tokens, lambda w: F.lower(w).isin(known)), lambda w: F.lower(w))
    counts = let(
        found, lambda f: F.transform(listed, lambda c: (F.size(f) - F.size(F.array_remove(f, c))).cast("double"))
    )
    rest = let(
        counts,
        lambda c: F.concat(c, F.array(F.size(tokens) - F.aggregate(c, F.lit(0.0), lambda a, x: a + x))),
    )
    return F.coalesce(rest, F.array().cast("array<double>"))


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda c: F.when(total > 0, c / total).otherwise(F.lit(0.0)))


def features(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The base counts and both histograms of every whole text; no text moves."""
    df = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), body("text").alias("t0"))
    df = df.select("*", words(F.col("t0")).alias("tokens"), F.length("t0").alias("n_chars"))
    lines = F.filter(F.split("t0", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    df = df.select(
        "*",
        F.size("tokens").cast("bigint").alias("n_words"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        let(F.col("tokens"), repeated_words).alias("n_repeat_words"),
        let(F.col("tokens"), lambda t: _common_counts(t, rules)).alias("word_counts"),
    ).drop("tokens")
    for k, (_, pattern) in enumerate(CLASSES):
        df = df.withColumn(f"t{k + 1}", F.regexp_replace(f"t{k}", pattern, ""))
    sizes = [F.length(f"t{k}") - F.length(f"t{k + 1}") for k in range(len(CLASSES))]
    at = {name: size for (name, _), size in zip(CLASSES, sizes)}
    classes = F.array(*[s.cast("double") for s in [*sizes, F.length(f"t{len(CLASSES)}")]])
    return df.select(
        "doc_id",
        "lang",
        "n_chars",
        "n_words",
        (F.col("n_chars") - at["space"]).cast("bigint").alias("word_chars"),
        at["symbol"].cast("bigint").alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        _shares(classes, F.col("n_chars")).alias("class_shares"),
        _shares(F.col("word_counts"), F.col("n_words")).alias("word_shares"),
    )


def references(feats: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Mean histograms of each language over its documents that pass the base rules."""
    n_words = 1 + max((len(w) for w in rules.common_words.values()), default=0)

    def mean(column: str, size: int) -> Column:
        return F.filter(F.array(*[F.avg(F.get(column, F.lit(i))) for i in range(size)]), lambda x: x.isNotNull())

    upper, lower = (F.get("class_shares", F.lit(k)) for k in (2, 0))
    plain = (10 * F.col("n_symbols") <= F.col("n_words")) & (upper <= lower)
    return (
        feats.filter(~F.col("base_failed") & (F.col("n_words") >= rules.min_words) & plain)
        .groupBy("lang")
        .agg(
            F.count("*").alias("n_reference"),
            mean("class_shares", len(CLASSES) + 1).alias("class_reference"),
            mean("word_shares", n_words).alias("word_reference"),
        )
        .filter(F.col("n_reference") >= rules.min_reference)
    )


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance in base 2: 0 for equal histograms, 1 for disjoint ones."""

    def bits(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: (bits(a, b) + bits(b, a)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def verdicts(feats: DataFrame, refs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Features with both distances (null where not compared) and ``kept``."""
    df = lookup(feats, refs, ["lang"])
    long_enough = F.col("n_reference").isNotNull() & (F.col("n_chars") >= rules.min_chars)
    wordy = F.col("n_reference").isNotNull() & (F.col("n_words") >= rules.min_words) & (F.size("word_shares") > 0)
    df = df.withColumns(
        {
            "class_distance": F.when(long_enough, F.round(distance(F.col("class_shares"), F.col("class_reference")), 6)),
            "word_distance": F.when(wordy, F.round(distance(F.col("word_shares"), F.col("word_reference")), 6)),
        }
    )
    allowed = {
        "class_distance": rules.class_floor + rules.class_noise / F.sqrt("n_chars"),
        "word_distance": rules.word_floor + rules.word_noise / F.sqrt("n_words"),
    }
    far = F.lit(False)
    for name, most in allowed.items():
        far = far | F.coalesce(F.col(name) > most, F.lit(False))
    return df.withColumn("kept", ~F.col("base_failed") & ~far)

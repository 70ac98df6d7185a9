"""Personal data: exact base spans, and candidate spans chosen by boosted trees.

Base spans come from four patterns with their validity checks.  High-recall
generators propose more spans, which may overlap; gradient-boosted trees score
each by its format and context, and a threshold calibrated on the candidates
held out of all documents selects those that are redacted as well.

Everything on the path of the documents is DataFrame expressions: patterns run
in the JVM, positions are prefix sums of piece lengths, and the trees become
nested conditions.  Trees are fitted by Spark's own boosting on about
``max_candidates`` candidates at most, an equal share for each generator and
label; thresholds come from the candidates of all documents.  Their labels are weak: a candidate is positive
if it overlaps a base span, or by evidence of its own (``_evidence``).

* Positions count code points; ends are exclusive.  A null text is empty.
* Base spans always stay.  A selected candidate that overlaps one adds nothing,
  except an address of which the base span is a part.
* Without candidates, or with one kind of label only, no span is added.
* Repeated rows get equal spans; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import body, boxed, let, unboxed

# The base patterns.  Possessive quantifiers, and anchors that
# let a match begin only where a run begins or the last match ended, keep the
# matches the same and the time linear in the text.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?+[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

# The generators.  ``address`` takes any token with an at sign,
# ``number`` any digit groups, ``secret`` any long value assigned to a name.
GENERATORS = {
    "address": r"(?<!\S)[^\s@]*+@\S*+",
    "number": r"[+(]?+[0-9](?:[ ().:/-]{0,2}+[0-9])++",
    "secret": r"(?<=[A-Za-z]\s{0,3}[=:]\s{0,3}[\"']{0,1})[A-Za-z0-9_/+-]{12,}+",
}
SECRET_NAMES = r"(?i)(?:token|key|secret|passw(?:or)?d|pwd|credential)s?\s*[=:]\s*[\"']?$"
CUES = r"(?i)(?:mail|phone|tel|call|fax|card|visa|ssn|iban|account|passport|address)\W*$"
# Evidence that does not depend on the base patterns.  National
# phone and id numbers in their groups, and addresses at an internationalised
# host or with a name of any letters.
NATIONAL = r"^(?:\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})$"
ANY_ADDRESS = r"^[^\s@]*[\p{L}\p{N}][^\s@]*@(?:[\p{L}\p{N}][\p{L}\p{N}-]*\.)+\p{L}{2,}\W*$"
CONTEXT = 24
CHUNK = 1000
SHARES = 1 << 30


@dataclass(frozen=True)
class Params:
    max_candidates: int = 20_000
    trees: int = 12
    depth: int = 3
    precision: float = 0.99
    seed: int = 5


@dataclass(frozen=True)
class Model:
    # Per tree: its weight and its nodes, a leaf value or (feature, split, left, right).
    trees: tuple = ()
    thresholds: dict = field(default_factory=dict)  # per generator; absent: nothing is selected


def _running(sizes: Column) -> Column:
    """Sums before each element, in two levels so that growing an array stays cheap."""

    def sums(part: Column, start: Column) -> Column:
        grown = F.aggregate(
            part,
            F.struct(start.alias("at"), F.array().cast("array<int>").alias("all")),
            lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")),
        )
        return grown["all"]

    def chunked(all_: Column) -> Column:
        chunks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int")),
            lambda c: F.slice(all_, c * CHUNK + 1, CHUNK),
        )

        def joined(parts: Column) -> Column:
            totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, n: a + n))
            return let(
                sums(totals, F.lit(0)),
                lambda begin: F.flatten(F.transform(parts, lambda p, i: sums(p, F.get(begin, i)))),
            )

        return F.when(F.size(all_) <= CHUNK, sums(all_, F.lit(0))).otherwise(let(chunks, joined))

    return let(sizes, chunked)


# What a text must hold for a pattern to match at all.  Most texts
# are settled by this cheap look.
MUST_HOLD = {EMAIL: "@", IP: "[0-9]", CARD: "[0-9]", PHONE: r"\+[0-9]"} | dict(
    zip(GENERATORS.values(), ("@", "[0-9]", "[=:]"))
)


def matches(text: Column, pattern: str) -> Column:
    """All matches, leftmost and not overlapping, as ``array<struct<start, end, value>>``."""

    def placed(both: Column) -> Column:
        gaps, hits = both["gaps"], both["hits"]
        steps = F.transform(hits, lambda h, i: F.length(h) + F.length(F.get(gaps, i + 1)))
        return F.transform(
            F.arrays_zip(hits.alias("h"), _running(steps).alias("b")),
            lambda z: F.struct(
                (F.length(F.get(gaps, F.lit(0))) + z["b"]).alias("start"),
                (F.length(F.get(gaps, F.lit(0))) + z["b"] + F.length(z["h"])).alias("end"),
                z["h"].alias("value"),
            ),
        )

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    both = F.struct(
        F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")
    )
    possible = F.regexp_like(text, F.lit(MUST_HOLD.get(pattern, pattern)))
    return F.when(possible, F.when(F.regexp_like(text, F.lit(pattern)), let(both, placed)).otherwise(none)).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    from_right = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(from_right, F.lit(0), lambda a, d: a + d) % 10 == 0


def valid_ip(value: Column) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    return (F.size(parts) == 4) & F.forall(
        parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255)
    )


def valid_card(value: Column) -> Column:
    return let(_digits(value), lambda d: F.length(d).between(14, 19) & F.when(F.length(d) <= 19, luhn(d)).otherwise(False))


def valid_phone(value: Column) -> Column:
    return F.length(_digits(value)).between(10, 15)


def base_spans(text: Column) -> dict[str, Column]:
    return {
        "email": matches(text, EMAIL),
        "ip": F.filter(matches(text, IP), lambda m: valid_ip(m["value"])),
        "card": F.filter(matches(text, CARD), lambda m: valid_card(m["value"])),
        "phone": F.filter(matches(text, PHONE), lambda m: valid_phone(m["value"])),
    }


def _features(text: Column, span: Column, generator: str) -> Column:
    """Format and context of one candidate as ``array<double>``."""
    value = span["value"]
    before = F.substring(text, F.greatest(span["start"] - CONTEXT, F.lit(0)) + 1, F.least(span["start"], F.lit(CONTEXT)))
    digits = F.length(_digits(value))
    letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    size = F.length(value)

    def flag(c: Column) -> Column:
        return F.when(c, 1.0).otherwise(0.0)

    return F.array(
        size.cast("double"),
        digits.cast("double"),
        letters.cast("double"),
        digits / size,
        flag(F.startswith(value, F.lit("+"))),
        flag(F.regexp_like(value, F.lit(r"^[^@]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+\W*$"))),
        flag(valid_ip(F.regexp_replace(value, "[^0-9.]", ""))),
        flag(valid_card(value)),
        flag(F.startswith(value, F.lit("+")) & valid_phone(value)),
        flag(F.regexp_like(before, F.lit(SECRET_NAMES))),
        flag(F.regexp_like(before, F.lit(CUES))),
        *[F.lit(float(g == generator)) for g in GENERATORS],
        flag(F.regexp_like(value, F.lit(NATIONAL))),
        flag(F.regexp_like(value, F.lit(ANY_ADDRESS))),
    )


def _overlaps(span: Column, spans: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))


def _evidence(generator: Column, f: Column) -> Column:
    """Whether a candidate is personal data by its own form and the words before it.

    Positions are those of ``_features``: a long mixed value assigned to a
    secret's name; a number in national groups, or of 7 to 19 digits after a
    cue word; an address with a name and a dotted host of any letters.
    """

    def at(i: int) -> Column:
        return F.get(f, F.lit(i))

    mixed = (at(1) >= 4) & (at(2) >= 4) & (at(0) >= 16)
    number = (at(14) == 1) | ((at(10) == 1) & at(1).between(7, 19))
    return (
        (mixed & (at(9) == 1))
        | ((generator == "number") & number)
        | ((generator == "address") & (at(15) == 1))
    )


def _adds(text: Column, span: Column, generator: str, base: Column) -> Column:
    """Whether a selected candidate redacts more than the base spans.

    One that overlaps a base span adds something only if it is an address whose
    name or host the base span cuts, as in ``jörg@example.com``.
    """
    if generator != "address":
        return ~_overlaps(span, base)
    met = F.filter(base, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))

    def cut(spans: Column) -> Column:
        first, last = F.array_min(F.transform(spans, lambda b: b["start"])), F.array_max(F.transform(spans, lambda b: b["end"]))
        before = F.substring(text, span["start"] + 1, F.greatest(first - span["start"], F.lit(0)))
        after = F.substring(text, last + 1, F.greatest(span["end"] - last, F.lit(0)))
        return (F.size(spans) == 0) | F.regexp_like(F.concat(before, F.lit(" "), after), F.lit(r"[\p{L}\p{N}]"))

    return let(met, cut)


def _candidates(text: Column, generator: str) -> Column:
    return F.transform(
        matches(text, GENERATORS[generator]),
        lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), _features(text, m, generator).alias("f")),
    )


def labelled_candidates(docs: DataFrame) -> DataFrame:
    """``generator, f, y, place, tested`` of every candidate; ``place`` is a hash of its place and text."""
    df = docs.select("doc_id", body("text").alias("text"))
    df = df.withColumn("base", F.concat(*base_spans(F.col("text")).values()))
    df = df.withColumn("mark", F.xxhash64("doc_id", "text"))
    sets = [
        df.select("mark", "base", F.lit(g).alias("generator"), F.explode(_candidates(F.col("text"), g)).alias("c"))
        for g in GENERATORS
    ]
    rows = sets[0].unionByName(sets[1]).unionByName(sets[2])
    positive = _overlaps(F.col("c"), F.col("base")) | _evidence(F.col("generator"), F.col("c.f"))
    y = F.when(positive, 1.0).otherwise(0.0)
    place = F.xxhash64("mark", "generator", "c.start")
    rows = rows.select("generator", "c.f", y.alias("y"), place.alias("place"))
    return rows.withColumn("tested", F.pmod("place", F.lit(3)) == 0)


def in_sample(rows: DataFrame, p: Params) -> Column:
    """Whether a candidate trains the trees: of those not tested an equal bound per generator and label, by hash."""
    most = p.max_candidates / (2 * len(GENERATORS))
    # At most two counts a generator reach the driver.
    counts = rows.filter(~F.col("tested")).groupBy("generator", "y").agg(F.count("*").alias("n")).collect()
    share = F.lit(0.0)
    for r in counts:
        same = (F.col("generator") == r["generator"]) & (F.col("y") == r["y"])
        share = F.when(same, min(1.0, most / r["n"])).otherwise(share)
    drawn = F.pmod(F.xxhash64("place", F.lit("fit")), F.lit(SHARES))
    return ~F.col("tested") & (drawn < F.ceil(share * SHARES))


def _parse_tree(lines: list[str]):
    """A tree from its printed form: ``If (feature i <= x)``, the branch, ``Else ...``, the branch, ``Predict: v``."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return float(line.split(":")[1])
    feature, split = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    left = _parse_tree(lines)
    lines.pop(0)
    return int(feature), float(split), left, _parse_tree(lines)


def _tree_value(tree, f: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    feature, split, left, right = tree
    return F.when(F.get(f, F.lit(feature)) <= split, _tree_value(left, f)).otherwise(_tree_value(right, f))


def score(trees: tuple, f: Column) -> Column:
    """The boosted probability that a candidate is personal data."""
    margin = F.lit(0.0)
    for weight, tree in trees:
        margin = margin + weight * _tree_value(tree, f)
    return 1 / (1 + F.exp(-2 * margin))


def fit(docs: DataFrame, p: Params = Params()) -> Model:
    """Boosted trees of a sample, and per generator the lowest threshold of the wanted precision on all candidates."""
    rows = labelled_candidates(docs)
    rows = rows.withColumn("trained", in_sample(rows, p))
    sample = rows.filter("trained").select("generator", "f", "y", "place")
    sample = sample.checkpoint() if _can_checkpoint(docs) else sample.cache()
    # In order of place, so that the trees do not depend on the partitions.
    train = sample.orderBy("place", "generator").select(array_to_vector("f").alias("features"), F.col("y").alias("label"))
    labels = train.agg(F.min("label"), F.max("label")).first()
    if labels[0] == labels[1]:
        return Model()
    learner = GBTClassifier(maxIter=p.trees, maxDepth=p.depth, seed=p.seed, checkpointInterval=-1)
    fitted = learner.fit(train)
    trees = tuple(
        (w, _parse_tree(t.toDebugString.strip().split("\n")[1:])) for w, t in zip(fitted.treeWeights, fitted.trees)
    )
    step = F.floor(score(trees, F.col("f")) * 100) / 100
    # At most 101 steps a generator, label and side of the sample reach the driver.
    found = rows.groupBy("generator", "y", "trained", step.alias("step")).agg(F.count("*").alias("n")).collect()
    return Model(trees, _thresholds([r.asDict() for r in found], p))


def _thresholds(found: list[dict], p: Params) -> dict:
    """Lowest step of the wanted precision, per generator.

    Candidates that trained the trees are stood for by the others of their
    generator and label, weighted up to the count of all; they count themselves
    only where there are no others.
    """
    weighted = defaultdict(lambda: [0.0, 0.0])
    for group in {(r["generator"], r["y"]) for r in found}:
        rows = [r for r in found if (r["generator"], r["y"]) == group]
        held = [r for r in rows if not r["trained"]] or rows
        weight = sum(r["n"] for r in rows) / sum(r["n"] for r in held)
        for r in held:
            both = weighted[r["generator"], r["step"]]
            both[0] += weight * r["n"]
            both[1] += weight * r["n"] * r["y"]
    thresholds = {}
    for g in GENERATORS:
        n = good = 0.0
        for step in sorted((s for kind, s in weighted if kind == g), reverse=True):
            n, good = n + weighted[g, step][0], good + weighted[g, step][1]
            if step >= 0.5 and good >= p.precision * n:
                thresholds[g] = step
    return thresholds


def _can_checkpoint(df: DataFrame) -> bool:
    return df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined()


def find(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``base`` and ``added``: spans ``start, rank, kind, end``, ordered by start and kind."""
    rows = boxed(docs).withColumn("text_", body("row.text"))
    named = base_spans(F.col("text_"))
    rows = rows.withColumns({f"b_{k}": v for k, v in named.items()})

    def shaped(spans: Column, kind: str, rank: int) -> Column:
        return F.transform(
            spans,
            lambda m: F.struct(
                m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end")
            ),
        )

    base = F.sort_array(F.concat(*[shaped(F.col(f"b_{k}"), k, i) for i, k in enumerate(KINDS)]))
    rows = rows.withColumn("base_", base)
    added = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    for i, (g, least) in enumerate(model.thresholds.items()):
        strong = F.filter(_candidates(F.col("text_"), g), lambda c: let(c["f"], lambda f: score(model.trees, f)) >= least)
        fresh = F.filter(strong, lambda c: _adds(F.col("text_"), c, g, F.col("base_")))
        added = F.concat(added, shaped(fresh, g, len(KINDS) + i))
    return unboxed(rows, docs.columns, base=F.col("base_"), added=F.sort_array(added))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``redacted``: every span replaced by its kind in brackets, overlapping ones by the first."""
    found = find(docs, model)
    spans = F.sort_array(F.concat("base", "added"))
    text = body("text")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        taken = F.concat(
            a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]")
        )
        return F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), taken.alias("out"))
        )

    done = F.aggregate(spans, zero, step)
    whole = let(done, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))))
    return found.withColumn("redacted", whole).drop("base", "added")

"""Ranked lexical search by a K2-treap over a grid of terms and documents.

The terms of every whole text are counted once and kept as a forward table.
Postings of asked terms are dealt to shards of documents.  A shard is a square
grid (rows: terms by falling weight, columns: documents by length norm) held as
a compressed quadtree: a cell exists only if it holds a posting, and stores the
largest impact below it.  A query descends with one path per term over ranges
of documents, best bound first: a range's bound is the sum of the maxima of the
cells its paths have reached, and a single column's bound is its exact score.
Ranges that cannot reach the k-th score found so far are left alone.

Items are asked in blocks.  A task holds one shard of about ``postings``
postings and one block of items; only its k best per item leave it.

* Null and empty texts hold no terms; they score nothing and are not counted
  among the documents with terms.
* Terms are compared by 64-bit hashes.
* Rows with a null ``doc_id`` take no part; rows sharing a ``doc_id`` are
  documents of their own, but of rows that also share all terms one is ranked
  (each counts in the statistics).
* Rows sharing an ``item_id`` are one item; rows with a null ``item_id`` take no
  part.  An item without a scoring document has no rows.
* Equal scores go to the smaller ``doc_id``.
* An empty table on either side gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.llm.common import modest_batches
from glyphmill.llm.flattext import flat, slices, word_hashes, word_limits
from glyphmill.plans.sizing import small_side
from glyphmill.session import written

TERM = np.zeros(256, bool)
TERM[0x80:] = True
for _first, _last in ("09", "AZ", "az"):
    TERM[ord(_first) : ord(_last) + 1] = True

FOUND = "item_id bigint, doc_id bigint, score bigint"
_SET_BITS = np.array([bin(i).count("1") for i in range(16)], np.int64)


@dataclass(frozen=True)
class Params:
    k: int = 10
    postings: int = 1_000_000
    items: int = 1024
    beam: int = 64


# -- terms -----------------------------------------------------------------------


def term_counts(rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``id, n, terms, counts``: per row its number of terms, distinct term hashes and their occurrences."""

    def count(batches):
        for batch in batches:
            ids = batch.column("id").cast(pa.int64())
            for at, texts in slices(batch.column("text")):
                data, offsets = flat(texts)
                starts, ends, first = word_limits(data, offsets, TERM[data])
                n = np.diff(first)
                h = word_hashes(data, starts, ends, lower=True)
                owner = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((h, owner))
                h, owner = h[order], owner[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                at_new = np.flatnonzero(new)
                tf = np.diff(np.append(at_new, len(h)))
                limits = pa.array(np.searchsorted(owner[at_new], np.arange(len(n) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, len(n)),
                        pa.array(n.astype(np.int64)),
                        pa.ListArray.from_arrays(limits, pa.array(h[at_new].view(np.int64))),
                        pa.ListArray.from_arrays(limits, pa.array(tf.astype(np.int64))),
                    ],
                    names=["id", "n", "terms", "counts"],
                )

    named = rows.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    schema = "id bigint, n bigint, terms array<bigint>, counts array<bigint>"
    return named.filter(F.col("id").isNotNull()).mapInArrow(count, schema)


# -- the grid ----------------------------------------------------------------------


def _spread(x: np.ndarray) -> np.ndarray:
    """Each bit of a 32-bit number moved to twice its place."""
    x = x.astype(np.uint64)
    for shift, mask in (
        (16, 0x0000FFFF0000FFFF),
        (8, 0x00FF00FF00FF00FF),
        (4, 0x0F0F0F0F0F0F0F0F),
        (2, 0x3333333333333333),
        (1, 0x5555555555555555),
    ):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class Treap:
    """A compressed quadtree with the largest value of every cell, root first, children side by side."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray):
        side = max(int(row.max(initial=0)), int(column.max(initial=0)))
        self.depth = side.bit_length()
        code = (_spread(row) << np.uint64(1)) | _spread(column)
        order = np.argsort(code)
        code, most = code[order], value[order]
        levels = [(np.zeros(len(code), np.uint8), np.zeros(len(code), np.int64), most)]
        for _ in range(self.depth):
            quadrant = np.left_shift(1, (code & np.uint64(3)).astype(np.uint8)).astype(np.uint8)
            code = code >> np.uint64(2)
            new = np.ones(len(code), bool)
            new[1:] = code[1:] != code[:-1]
            first = np.flatnonzero(new)
            code, most = code[first], np.maximum.reduceat(most, first)
            levels.append((np.bitwise_or.reduceat(quadrant, first), first, most))
        levels.reverse()
        begin = 0
        parts = []
        for mask, first, most in levels:
            begin += len(mask)  # children begin where this level ends
            parts.append((mask, first + begin, most))
        self.mask, self.first, self.most = (np.concatenate(c) for c in zip(*parts))

    def children(self, node: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        """The child in a quadrant of every node; -1 where either does not exist."""
        mask = np.where(node >= 0, self.mask[node], 0).astype(np.int64)
        child = self.first[node] + _SET_BITS[mask & ((1 << quadrant) - 1)]
        return np.where(mask >> quadrant & 1, child, -1)


def best(tree: Treap, rows: np.ndarray, names: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns for a set of rows: names and scores, best first, ties to the smaller name."""
    none = np.zeros(0, np.int64)
    found_n, found_s, kth = none, none, 1
    level, column = np.array([tree.depth]), np.array([0])
    node = np.zeros((1, len(rows)), np.int64)
    bound = np.array([tree.most[0] * len(rows)])
    while len(bound):
        if len(bound) > p.beam:
            pick = np.argpartition(-bound, p.beam)[: p.beam]
            rest = np.ones(len(bound), bool)
            rest[pick] = False
        else:
            pick, rest = np.arange(len(bound)), np.zeros(len(bound), bool)
        leaf = level[pick] == 0
        if leaf.any():
            done = pick[leaf]
            found_n = np.concatenate([found_n, names[column[done]]])
            found_s = np.concatenate([found_s, bound[done]])
            order = np.lexsort((found_n, -found_s))[: p.k]
            found_n, found_s = found_n[order], found_s[order]
            if len(found_s) == p.k:
                kth = int(found_s[-1])
        pick = pick[~leaf]
        below = level[pick] - 1
        row_bit = (rows[None, :] >> below[:, None]) & 1
        new = []
        for bit in (0, 1):
            child = tree.children(node[pick], row_bit * 2 + bit)
            new.append((below, column[pick] * 2 + bit, child, np.where(child >= 0, tree.most[child], 0).sum(axis=1)))
        columns = [np.concatenate([old[rest], new[0][i], new[1][i]]) for i, old in enumerate((level, column, node, bound))]
        keep = columns[3] >= kth
        level, column, node, bound = (c[keep] for c in columns)
    return found_n, found_s


def search(postings: pa.Table, asked: pa.Table, p: Params) -> pa.Table:
    """Up to k best documents of one shard for every asked item.

    ``postings``: ``doc_id, line`` (a document row), ``norm``, ``term``, ``tf``;
    ``asked``: ``item_id, term, weight``.
    """
    out: tuple[list, list, list] = ([], [], [])
    term, weight = asked.column("term").to_numpy(), asked.column("weight").to_numpy()
    if len(postings) and len(term):
        by_weight = np.lexsort((term, -weight))
        ordered = term[by_weight]
        first = np.sort(np.unique(ordered, return_index=True)[1])
        row_term, row_weight = ordered[first], weight[by_weight][first]
        by_hash = np.argsort(row_term)
        place = lambda t: by_hash[np.searchsorted(row_term[by_hash], t)]

        line, norm = postings.column("line").to_numpy(), postings.column("norm").to_numpy()
        lines, at, back = np.unique(line, return_index=True, return_inverse=True)
        by_norm = np.lexsort((lines, norm[at]))
        column_of = np.empty(len(lines), np.int64)
        column_of[by_norm] = np.arange(len(lines))
        names = postings.column("doc_id").to_numpy()[at][by_norm]
        row, tf = place(postings.column("term").to_numpy()), postings.column("tf").to_numpy()
        impact = row_weight[row] * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm))
        column = column_of[back]
        _, once = np.unique(row * len(lines) + column, return_index=True)
        tree = Treap(row[once], column[once], impact[once])

        present = np.isin(term, postings.column("term").to_numpy())
        item, row_of = asked.column("item_id").to_numpy()[present], place(term[present])
        order = np.argsort(item, kind="stable")
        item, row_of = item[order], row_of[order]
        for me, rows in zip(np.unique(item), np.split(row_of, np.flatnonzero(item[1:] != item[:-1]) + 1)):
            found, scores = best(tree, np.unique(rows), names, p)
            out[0].extend([int(me)] * len(found))
            out[1].extend(found.tolist())
            out[2].extend(scores.tolist())
    return pa.table(dict(zip(("item_id", "doc_id", "score"), (pa.array(c, pa.int64()) for c in out))))


def top_k(docs: DataFrame, items: DataFrame, params: Params = Params()) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents (``doc_id, text``) of each item (``item_id, text``)."""
    p = params
    modest_batches(docs.sparkSession)
    forward = written(term_counts(docs, "doc_id", "text"), "forward")
    n_docs, n_terms = forward.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()

    asked = term_counts(items, "item_id", "text").select(F.col("id").alias("item_id"), F.explode("terms").alias("term"))
    asked = written(asked.distinct(), "asked")
    n_items = asked.select("item_id").distinct().count()
    block = F.pmod(F.xxhash64("item_id"), F.lit(max(1, -(-n_items // p.items)))).cast("int")
    asked = asked.withColumn("block", block)

    wanted = small_side(asked.select("term", "block").distinct())
    norm = F.expr(f"100 - 90 + ((90 * cast(n as decimal(20,0)) * {n_docs}) div {max(n_terms, 1)})")
    lines = forward.filter("n > 0").select(F.col("id").alias("doc_id"), norm.alias("norm"), "terms", "counts")
    # Rows that share an id and a text are equal, so a hash of the terms tells documents of one id apart.
    line = F.xxhash64("doc_id", "terms", "counts").alias("line")
    lines = lines.select("doc_id", line, "norm", F.explode(F.arrays_zip("terms", "counts")).alias("t"))
    lines = lines.select("doc_id", "line", "norm", F.col("t.terms").alias("term"), F.col("t.counts").alias("tf"))
    postings = written(lines.join(wanted, "term"), "postings")
    sizes = postings.groupBy("term", "block").agg(F.count("*").alias("df"))
    sizes = written(sizes, "document-frequencies")
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("bigint")
    asked = asked.join(small_side(sizes.select("term", "block", weight.alias("weight"))), ["term", "block"])
    n_shards = max(1, -(-(sizes.agg(F.sum("df")).first()[0] or 0) // p.postings))
    shard = F.pmod(F.col("line"), F.lit(n_shards)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))

    def task(postings: pa.Table, asked: pa.Table) -> pa.Table:
        return search(postings, asked, p)

    dealt = postings.withColumn("shard", shard).groupBy("shard", "block")
    met = dealt.cogroup(asked.withColumn("shard", every).groupBy("shard", "block")).applyInArrow(task, FOUND)
    order = W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= p.k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")

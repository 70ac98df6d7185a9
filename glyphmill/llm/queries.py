"""Registered queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import (
    balltree,
    divergence,
    jaccard,
    limbcodes,
    linededup,
    mixing,
    neighbours,
    pii,
    popcounts,
    slackpack,
    treap,
    urllists,
    warc,
)
from glyphmill.llm.sql import ORACLES as ORACLES
from glyphmill.plans.sizing import global_rank, small_side
from glyphmill.session import written
from glyphmill.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_distribution_divergence(spark, sf_dir):
    feats = written(divergence.features(table(spark, sf_dir, "documents")), "divergence")
    return divergence.verdicts(feats, divergence.references(feats)).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "class_distance",
        "word_distance",
    )


@query
def op2_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.drop_shared_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256")
    )


@query
def op10_neighbour_voting(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = neighbours.score_documents(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", neighbours.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op9_ball_tree_top_k(spark, sf_dir):
    return balltree.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


@query
def op3_raked_mixing(spark, sf_dir):
    drawn = mixing.draw(table(spark, sf_dir, "documents"))
    return drawn.select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "drawn")


@query
def op4_boosted_candidates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    spans = F.sort_array(F.concat("base", "added"))
    return found.select(
        "doc_id",
        *[count(k) for k in pii.KINDS],
        F.sha2(F.encode(pii.listed(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        pii.listed(spans).alias("spans"),
    )


@query
def op5_minimum_bin_slack(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return slackpack.pack(docs, slackpack.Params(public_tokenizers.path("word_bpe_49k.json")))


@query
def op6_jaccard_join(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op7_warc_bundles(spark, sf_dir):
    return warc.read_bundles(warc.archive(table(spark, sf_dir, "pages")))


@query
def op11_term_grid_treap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return treap.top_k(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


@query
def op12_segment_popcounts(spark, sf_dir):
    return popcounts.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op13_limb_codes(spark, sf_dir):
    return limbcodes.compress(table(spark, sf_dir, "embeddings"))


# What an event reported on a page does to the dated lists.
LIST_ACTIONS = {
    "error": ("malware", "block", "add"),
    "signup": ("malware", "block", "remove"),
    "click": ("ads", "block", "add"),
    "view": ("ads", "block", "remove"),
    "purchase": ("partners", "allow", "add"),
}


def _changes(events):
    """``events`` (pattern, event_type, at) as list entries."""
    changes = F.lit(None).cast("struct<list_name:string,kind:string,action:string>")
    for kind, (name, what, action) in LIST_ACTIONS.items():
        change = F.struct(F.lit(name).alias("list_name"), F.lit(what).alias("kind"), F.lit(action).alias("action"))
        changes = F.when(F.col("event_type") == kind, change).otherwise(changes)
    return events.select("pattern", "at", changes.alias("c")).select("pattern", "at", "c.*")


def list_entries(events, pages):
    """Every event changes a list for one host: the distinct hosts in md5 order, taken in turn by event id."""
    hosts = pages.select(urllists.host(F.col("url")).alias("pattern")).dropna().distinct()
    hosts = hosts.select(F.lit(0).alias("all"), "pattern", F.md5(F.col("pattern").cast("binary")).alias("hex"))
    hosts = written(global_rank(hosts, ["all"], "hex", ["pattern"], "rank", "n").select("pattern", "rank"), "hosts")
    n = hosts.count()
    place = F.pmod(F.coalesce("event_id", F.lit(0)), F.lit(max(n, 1))).cast("bigint")
    events = events.select(place.alias("rank"), "event_type", F.col("ts").alias("at"))
    return _changes(events.join(small_side(hosts, rows=n), "rank"))


def _captures(spark, sf_dir):
    second = F.lit(1_704_067_200) + F.pmod(F.col("page_id") * 7919, F.lit(30 * 86_400))
    captures = table(spark, sf_dir, "pages").select("page_id", "url", second.alias("fetched"))
    return captures.select("page_id", "url", F.timestamp_seconds("fetched").alias("fetch_time"))


def _judged(captures, entries):
    return urllists.judge(captures, entries).select(
        "page_id", "host", F.unix_seconds("fetch_time").alias("fetched"), "n_matches", "lists", "entry", "blocked"
    )


@query
def op8_temporal_url_lists(spark, sf_dir):
    entries = list_entries(table(spark, sf_dir, "events"), table(spark, sf_dir, "pages"))
    return _judged(_captures(spark, sf_dir), entries)

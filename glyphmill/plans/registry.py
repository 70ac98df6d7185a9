"""The registered queries: one callable per operator, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import bytelevel as bl
from glyphmill.functions import draw, graphs
from glyphmill.functions import text as tx
from glyphmill.operators import bpe as bp
from glyphmill.operators import diagrams
from glyphmill.operators import evaluate as ev
from glyphmill.operators import instruct, lexicon, nearest, packing, pairs, paraphrase, runs, synthesize
from glyphmill.plans import inputs as i
from glyphmill.session import work_path, written
from glyphmill.sources import stores, tokenfile
from glyphmill.sources.grammar import grammar
from glyphmill.sources.tables import read_corpus, table
from glyphmill.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SLICE = 500
BATCH = 32
BLOCK = 512
DECLARED_VOCABULARY = 8192


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _md5_of(text):
    return F.md5(text.cast("binary"))


def _md5(column: str):
    return _md5_of(F.col(column))


def _ids_md5(ids):
    return _md5_of(F.array_join(ids.cast("array<string>"), ","))


# -- sources and sinks ----------------------------------------------------------


@query
def read_corpus_slice(spark, sf_dir):
    docs = read_corpus(spark, f"{sf_dir}/documents.parquet", SLICE)
    return docs.select("doc_id", "lang", "source", _md5("text").alias("text_md5"))


@query
def mixed_corpus(spark, sf_dir):
    lines = pairs.tokenizer_lines(i.kit(spark, sf_dir).pool, i.distinct(spark, sf_dir))
    mixed = pairs.mixed_corpus(lines, i.documents(spark, sf_dir))
    return mixed.select("origin", "copy", "line", _md5("text").alias("text_md5"))


def _flat_pairs(df):
    return df.select(
        "pair_id", "split", "shape", "prompt", "diagram", i.slot_text(F.col("slots")).alias("slot_text"), "novel"
    )


@query
def pairs_json_roundtrip(spark, sf_dir):
    path = work_path(spark, "pairs")
    stores.write_pairs(i.distinct(spark, sf_dir), path)
    return _flat_pairs(stores.read_pairs(spark, path))


def _written_tokens(spark, sf_dir):
    return written(i.token_table(spark, sf_dir).withColumn("n", F.size("ids")), "tokens")


# Keeps sums of block checksums within 64 bits at any size; prime.
CHECKSUM_BASE = 2**31 - 1


def _stored_blocks(spark, blocks):
    path = work_path(spark, "blocks")
    stores.write_blocks(blocks, path)
    stores.write_blocks(blocks, path)  # present, so kept
    return stores.read_blocks(spark, path)


@query
def token_shards(spark, sf_dir):
    """The texts that come back out of stored shards, and per split blocks, ids and checksum of the shards of plain ids."""
    blocks, plain = _both_blocks(spark, sf_dir)
    total = F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, t: a + t)
    sums = _stored_blocks(spark, plain).groupBy("split").agg(
        F.count("*").alias("n_blocks"),
        F.sum(F.size("tokens")).alias("n_plain_ids"),
        F.sum(total * (F.col("block_id") + 1) % CHECKSUM_BASE).alias("checksum"),
    )
    return _unpacked(spark, sf_dir, _stored_blocks(spark, blocks)).join(sums, "split")


@query
def token_file(spark, sf_dir):
    path = work_path(spark, "token-file")
    tokenfile.write_token_file(_written_tokens(spark, sf_dir), path)
    return _unpacked(spark, sf_dir, tokenfile.read_token_file(spark, path, BLOCK))


def _phrase_use(spark, sf_dir):
    """How often the orders draw each paraphrase."""
    kit = i.kit(spark, sf_dir)
    keys = pairs.split_keys(i.order_ids(spark, sf_dir))
    drawn = pairs.draw_phrase(pairs.draw_shape(keys, kit), kit)
    return drawn.groupBy("shape", "split", "paraphrase").agg(F.count("*").alias("n_pairs"))


@query
def grammar_tables(spark, sf_dir):
    tables = grammar(spark)
    frames = tables["frames"].groupBy("shape").agg(F.count("*").alias("n_frames"))
    options = tables["connectives"].groupBy("shape").agg(F.count("*").alias("n_options"))
    use = _phrase_use(spark, sf_dir).groupBy("shape").agg(F.sum("n_pairs").alias("n_pairs"))
    return (
        tables["shapes"].join(frames, "shape").join(options, "shape").join(use, "shape")
        .select("shape", "pattern", "n_frames", "n_options", "n_pairs")
    )


@query
def shape_graphs(spark, sf_dir):
    """Node and edge tables of the shapes, with the number of pairs whose own graph has that node or edge."""
    shapes = _shapes(spark)
    made = written(diagrams.with_graph(i.distinct(spark, sf_dir)).select("shape", "graph"), "graphs")
    slot = F.coalesce("slot", F.lit(""))
    nodes = diagrams.shape_nodes(shapes).select("shape", "node_id", "kind", slot.alias("slot"))
    nodes = nodes.select("shape", F.concat_ws(":", "node_id", "kind").alias("item"), "slot")
    edges = diagrams.shape_edges(shapes).select(
        "shape", F.concat("src", F.lit(">"), "dst").alias("item"), F.concat(F.coalesce("label", F.lit("")), slot).alias("slot")
    )
    drawn_nodes = diagrams.graph_nodes(made, "shape").select("shape", F.concat_ws(":", "node", "kind").alias("item"))
    drawn_edges = diagrams.graph_edges(made, "shape").select("shape", F.concat("src", F.lit(">"), "dst").alias("item"))
    used = drawn_nodes.unionByName(drawn_edges).groupBy("shape", "item").agg(F.count("*").alias("n_pairs"))
    return nodes.unionByName(edges).join(used, ["shape", "item"], "left")


@query
def vocab_tables(spark, sf_dir):
    path = work_path(spark, "vocab")
    stores.write_vocab(*bp.vocab_tables(spark, i.vocabulary(spark, sf_dir)), path)
    vocab, merges = stores.read_vocab(spark, path)
    return vocab.join(merges.select(F.col("merged").alias("token"), "rank"), "token", "left").select(
        "token", F.col("id").cast("bigint").alias("id"), "kind", F.col("rank").cast("bigint").alias("rank")
    )


# -- projections, filters, scalar functions --------------------------------------


@query
def lexicon_token_cost_filter(spark, sf_dir):
    words = i.document_words(spark, sf_dir)
    return bp.filter_by_cost(words, i.vocabulary(spark, sf_dir)).select("word")


@query
def lexicon_floor_check(spark, sf_dir):
    return lexicon.check_floor(i.lexicon_words(spark, sf_dir))


@query
def slot_category(spark, sf_dir):
    slots = i.drawn(spark, sf_dir).select("pair_id", F.explode(F.map_keys("slots")).alias("slot"))
    return slots.withColumn("category", tx.slot_category(F.col("slot")))


@query
def shape_slots(spark, sf_dir):
    shaped = pairs.draw_shape(i.order_ids(spark, sf_dir), i.kit(spark, sf_dir))
    return shaped.select("pair_id", "shape", F.array_join(tx.slot_names(F.col("pattern")), ",").alias("slots"))


@query
def vocab_fragments(spark, sf_dir):
    freq = bp.pretoken_frequencies(i.documents(spark, sf_dir))
    return lexicon.vocab_fragments(freq.select(F.translate("pretoken", " ", "Ġ").alias("token")))


@query
def render_pairs(spark, sf_dir):
    return i.drawn(spark, sf_dir).select("pair_id", "prompt", "diagram")


def _prompt_texts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.lit("turn"), "conv_id", "turn").alias("key"), F.col("text").alias("prompt")
    )
    prompts = i.drawn(spark, sf_dir).select(F.concat_ws("-", F.lit("order"), "pair_id").alias("key"), "prompt")
    return turns.unionByName(prompts)


@query
def diagram_graphs(spark, sf_dir):
    """Every pair's diagram as a graph, written again from it, and drawn from the shapes' node and edge tables."""
    shapes = _shapes(spark)
    made = diagrams.with_graph(i.distinct(spark, sf_dir))
    made = diagrams.render_from_tables(made, diagrams.shape_nodes(shapes), diagrams.shape_edges(shapes))
    return made.select(
        "pair_id",
        F.size(F.col("graph")["nodes"]).cast("bigint").alias("n_nodes"),
        graphs.listed_nodes(F.col("graph")).alias("nodes"),
        graphs.listed_edges(F.col("graph")).alias("edges"),
        (graphs.render_graph(F.col("graph")) == F.col("diagram")).alias("survives"),
        (F.col("drawn") == F.col("diagram")).alias("drawn_same"),
    )


@query
def title_case_warning(spark, sf_dir):
    return _prompt_texts(spark, sf_dir).select("key", tx.casing_warning(F.col("prompt")).alias("warn"))


def _header(key):
    """No header, the flowchart header or the state-diagram header, by key."""
    return F.when(i.opener_flag(key) == 1, "graph TD").when(i.opener_flag(key) == 2, "stateDiagram-v2")


@query
def sanitize_diagrams(spark, sf_dir):
    samples = i.predicted(spark, sf_dir).withColumn("header", _header(F.col("pair_id")))
    return samples.select("pair_id", "header", tx.sanitize(F.col("generated"), F.col("header")).alias("code"))


@query
def reassemble_output(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn") + 1_000_000_000).alias("key"), "text"
    )
    outputs = i.predicted(spark, sf_dir).select(
        F.col("pair_id").alias("key"), F.concat(F.lit("  sure: "), "generated", F.lit("<|endoftext|>")).alias("text")
    )
    both = turns.unionByName(outputs).withColumn("header", _header(F.col("key")))
    return both.select("key", "header", tx.reassemble(F.col("text"), F.col("header")).alias("code"))


@query
def normalize_code(spark, sf_dir):
    docs = i.documents(spark, sf_dir).select(F.lit("document").alias("origin"), F.col("doc_id").alias("key"), "text")
    codes = i.predicted(spark, sf_dir).select(
        F.lit("output").alias("origin"), F.col("pair_id").alias("key"), F.col("generated").alias("text")
    )
    return docs.unionByName(codes).select(
        "origin", "key", F.md5(tx.normalize(F.col("text")).cast("binary")).alias("code_md5")
    )


@query
def diagram_skeleton(spark, sf_dir):
    values = F.transform(F.array_sort(F.map_entries("slots")), lambda e: e["value"])
    return i.predicted(spark, sf_dir).select(
        "pair_id",
        tx.skeleton(F.col("diagram"), values).alias("target"),
        tx.skeleton(F.col("generated"), values).alias("output"),
    )


@query
def vocab_bounds_check(spark, sf_dir):
    size = i.vocabulary(spark, sf_dir).size
    return bp.check_vocab(i.token_table(spark, sf_dir), size, DECLARED_VOCABULARY, "ids")


@query
def diagram_openers(spark, sf_dir):
    return paraphrase.openers(i.drawn(spark, sf_dir), "diagram")


@query
def prefix_token_audit(spark, sf_dir):
    drawn = i.drawn(spark, sf_dir).select(
        "shape",
        F.col("diagram").alias("full"),
        F.explode(F.array(F.lit("graph TD\n    A"), F.lit("graph TD\n   "), F.lit("graph TD\n    "))).alias("prefix"),
    )
    audit = bp.prefix_audit(drawn, i.vocabulary(spark, sf_dir))
    return audit.groupBy("shape", "prefix").agg(
        F.count("*").alias("n"), F.sum(F.col("agrees").cast("bigint")).alias("n_agree")
    )


# -- tokenizer ---------------------------------------------------------------------


@query
def pretokenize(spark, sf_dir):
    return bp.pretokenize(i.documents(spark, sf_dir)).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "pretoken"
    )


@query
def pretoken_frequencies(spark, sf_dir):
    return bp.pretoken_frequencies(i.documents(spark, sf_dir))


@query
def bpe_pair_counts(spark, sf_dir):
    table_ = bp.symbol_table(bp.pretoken_frequencies(i.documents(spark, sf_dir)))
    return bp.pair_counts(table_).select(
        F.col("left").cast("bigint").alias("left_id"), F.col("right").cast("bigint").alias("right_id"), "n"
    )


@query
def bpe_train(spark, sf_dir):
    _, merges = bp.vocab_tables(spark, i.vocabulary(spark, sf_dir))
    return merges.select(
        F.col("rank").cast("bigint").alias("rank"),
        F.col("left").alias("left_token"),
        F.col("right").alias("right_token"),
        "merged",
    )


@query
def bpe_encode(spark, sf_dir):
    """What the ids of every text stand for, and the ids themselves by the plain vocabulary."""
    bpe = i.vocabulary(spark, sf_dir)
    ids = i.documents(spark, sf_dir).withColumns(
        {"ids": bp.encode(F.col("text"), bpe), "plain_ids": i.plain_ids(spark, sf_dir)}
    )
    return ids.select(
        "doc_id",
        bp.token_bytes(F.col("ids"), bpe).alias("n_bytes"),
        _md5_of(F.array_join(bp.token_strings(F.col("ids"), bpe), "")).alias("shown_md5"),
        F.forall("ids", lambda t: (t >= bl.FIRST_BYTE) & (t < bpe.size)).alias("in_range"),
        F.size("plain_ids").cast("bigint").alias("n_plain_ids"),
        _ids_md5(F.col("plain_ids")).alias("plain_ids_md5"),
    )


@query
def bpe_decode(spark, sf_dir):
    bpe = i.vocabulary(spark, sf_dir)
    ids = i.documents(spark, sf_dir).withColumn("ids", bp.encode(F.col("text"), bpe))
    return ids.select(
        "doc_id", F.md5(bp.decode(F.col("ids"), bpe, skip_special=False).cast("binary")).alias("text_md5")
    )


@query
def token_cost_report(spark, sf_dir):
    pool = i.kit(spark, sf_dir).pool.select("category", "value").distinct()
    inside = pool.select(F.concat(F.lit("pool_"), "category").alias("grp"), F.col("value").alias("probe"))
    outside = i.document_words(spark, sf_dir).select(F.lit("corpus").alias("grp"), F.col("word").alias("probe"))
    return bp.token_cost(inside.unionByName(outside), i.vocabulary(spark, sf_dir))


def _fit(spark, sf_dir):
    words = i.lexicon_words(spark, sf_dir).unionByName(i.document_words(spark, sf_dir))
    return bp.vocab_fit(words, i.vocabulary(spark, sf_dir))


@query
def cheap_costly_words(spark, sf_dir):
    return bp.vocab_fit_report(_fit(spark, sf_dir))


@query
def cheap_word_pairs(spark, sf_dir):
    return bp.cheap_pairs(_fit(spark, sf_dir), i.vocabulary(spark, sf_dir))


@query
def split_token_totals(spark, sf_dir):
    """Documents, bytes and ends per split, and the totals of plain ids."""
    tokens = i.token_table(spark, sf_dir, plain=True)
    return bp.token_conservation(tokens, i.vocabulary(spark, sf_dir), totals="plain_ids")


# -- lexicon and grammar -------------------------------------------------------------


@query
def label_pools(spark, sf_dir):
    return lexicon.label_pools(i.kit_words(spark, sf_dir))


@query
def pool_value_split(spark, sf_dir):
    return lexicon.split_pools(lexicon.label_pools(i.kit_words(spark, sf_dir)))


@query
def lexicon_report(spark, sf_dir):
    n_dropped = lexicon.dropped_words(*i.lexicon_sources(spark, sf_dir)).count()
    return lexicon.lexicon_report(lexicon.split_pools(lexicon.label_pools(i.kit_words(spark, sf_dir))), n_dropped)


@query
def enumerate_paraphrases(spark, sf_dir):
    tables = grammar(spark)
    all_forms = paraphrase.expand(tables["frames"], tables["connectives"])
    use = _phrase_use(spark, sf_dir).drop("split")
    return all_forms.join(use, ["shape", "paraphrase"], "left").select(
        "shape", "paraphrase", F.coalesce("n_pairs", F.lit(0)).cast("bigint").alias("n_pairs")
    )


@query
def paraphrase_split(spark, sf_dir):
    use = _phrase_use(spark, sf_dir)
    return i.kit(spark, sf_dir).phrases.join(use, ["shape", "split", "paraphrase"], "left").select(
        "shape", "split", "idx", "paraphrase", F.coalesce("n_pairs", F.lit(0)).cast("bigint").alias("n_pairs")
    )


@query
def paraphrase_report(spark, sf_dir):
    use = _phrase_use(spark, sf_dir).rollup("shape").agg(F.sum("n_pairs").alias("n_pairs"))
    use = use.withColumn("shape", F.coalesce("shape", F.lit("TOTAL")))
    return paraphrase.paraphrase_report(i.kit(spark, sf_dir).phrases).join(use, "shape")


@query
def grammar_ambiguity_audit(spark, sf_dir):
    kit = i.kit(spark, sf_dir)
    keys = pairs.split_keys(i.order_ids(spark, sf_dir))
    spoken = pairs.draw_phrase(pairs.draw_shape(keys, kit), kit)
    return paraphrase.skeleton_shapes(spoken).withColumn("ambiguous", F.col("n_shapes") > 1)


@query
def split_leakage_audit(spark, sf_dir):
    kit = i.kit(spark, sf_dir)
    drawn = i.drawn(spark, sf_dir)
    open_values = kit.pool.filter(~F.col("category").isin(*lexicon.CLOSED_CATEGORIES))
    spoken = pairs.draw_phrase(pairs.draw_shape(pairs.split_keys(i.order_ids(spark, sf_dir)), kit), kit)
    checks = lexicon.leakage(open_values, "values", "value")
    checks = checks.unionByName(lexicon.leakage(spoken, "paraphrases", "paraphrase"))
    return checks.unionByName(lexicon.leakage(drawn, "prompts", "prompt"))


# -- sampling and pairs ----------------------------------------------------------------


@query
def sample_slots(spark, sf_dir):
    kit = i.kit(spark, sf_dir)
    keys = pairs.split_keys(i.order_ids(spark, sf_dir)).withColumn("novel", F.lit(False))
    slots = pairs.sample_slots(pairs.draw_shape(keys, kit), kit)
    return slots.select("pair_id", "split", "shape", i.slot_text(F.col("slots")).alias("slot_text"))


@query
def novel_spans(spark, sf_dir):
    fragments = i.kit(spark, sf_dir).fragments
    return i.order_ids(spark, sf_dir).select(
        "pair_id",
        pairs.novel_value(F.col("pair_id"), F.lit("act_1"), fragments).alias("span_1"),
        pairs.novel_value(F.col("pair_id"), F.lit("cond_1"), fragments).alias("span_2"),
    )


@query
def novel_slots(spark, sf_dir):
    kit = i.kit(spark, sf_dir)
    keys = pairs.split_keys(i.order_ids(spark, sf_dir)).withColumn("novel", F.lit(True))
    slots = pairs.sample_slots(pairs.draw_shape(keys, kit), kit)
    return slots.select("pair_id", "split", "shape", i.slot_text(F.col("slots")).alias("slot_text"))


@query
def generate_pairs(spark, sf_dir):
    return _flat_pairs(i.distinct(spark, sf_dir))


@query
def pair_mix_report(spark, sf_dir):
    return pairs.pair_mix_report(i.distinct(spark, sf_dir))


@query
def axis_sets(spark, sf_dir):
    sets = pairs.axis_sets(i.order_ids(spark, sf_dir), i.kit(spark, sf_dir))
    return sets.select("pair_id", "axis", "shape", "prompt", "diagram")


@query
def tokenizer_corpus_sample(spark, sf_dir):
    return pairs.tokenizer_lines(i.kit(spark, sf_dir).pool, i.distinct(spark, sf_dir))


# -- sequence building -------------------------------------------------------------------


@query
def document_split(spark, sf_dir):
    return packing.split_docs(i.documents(spark, sf_dir)).select("doc_id", "split")


@query
def append_eot(spark, sf_dir):
    text = bp.decode(F.col("ids"), i.vocabulary(spark, sf_dir))
    return i.token_table(spark, sf_dir, plain=True).select(
        "doc_id",
        F.size(F.filter("ids", lambda t: t == bl.EOT)).cast("bigint").alias("n_ends"),
        F.element_at("ids", -1).cast("bigint").alias("last_id"),
        _md5_of(text).alias("text_md5"),
        F.size("plain_ids").cast("bigint").alias("n_plain_ids"),
        F.element_at("plain_ids", -1).cast("bigint").alias("last_plain_id"),
    )


# The ids of both vocabularies (8,192 and 279 entries) fit 16 bits.
ID_TYPE = "smallint"


def _packed(tokens):
    return packing.pack_blocks(tokens, BLOCK, keep_tail=True, id_type=ID_TYPE)


def _blocks(spark, sf_dir):
    return _packed(_written_tokens(spark, sf_dir))


def _both_blocks(spark, sf_dir):
    """``_blocks``, and the blocks of plain ids."""
    tokens = i.token_table(spark, sf_dir, plain=True)
    tokens = written(tokens.withColumns({"n": F.size("ids"), "n_plain": F.size("plain_ids")}), "tokens")
    plain = tokens.select("doc_id", "split", F.col("plain_ids").alias("ids"), F.col("n_plain").alias("n"))
    return _packed(tokens.select("doc_id", "split", "ids", "n")), _packed(plain)


def _unpacked(spark, sf_dir, blocks):
    """The texts that come back out of packed blocks, per split."""
    ids = packing.unpack_blocks(blocks, BLOCK, id_type=ID_TYPE)
    text = bp.decode(F.col("ids"), i.vocabulary(spark, sf_dir))
    return ids.select("split", _md5_of(text).alias("text_md5")).groupBy("split", "text_md5").agg(F.count("*").alias("n_docs"))


@query
def pack_blocks(spark, sf_dir):
    return _unpacked(spark, sf_dir, _blocks(spark, sf_dir))


@query
def next_token_pairs(spark, sf_dir):
    """The texts that come back out of all ``x``, whether ``y`` follows; and one row per block of plain ids."""
    blocks, plain = _both_blocks(spark, sf_dir)
    # The rows of plain ids first: what they shuffle is gone before the others are packed.
    rows = packing.next_token_pairs(plain, BLOCK).select(
        "split", "block_id", _ids_md5(F.col("x")).alias("x_md5"), _ids_md5(F.col("y")).alias("y_md5")
    )
    rows = written(rows, "plain-pairs")
    examples = written(packing.next_token_pairs(blocks, BLOCK), "next-token-pairs")
    follows = F.slice("x", F.lit(2), F.size("x")) == F.slice("y", F.lit(1), F.greatest(F.size("x") - 1, F.lit(0)))
    chained = examples.groupBy("split").agg(F.bool_and(follows).alias("y_follows"))
    back = _unpacked(spark, sf_dir, examples.withColumnRenamed("x", "tokens"))
    return back.join(chained, "split").unionByName(rows, allowMissingColumns=True)


@query
def epoch_batches(spark, sf_dir):
    blocks = written(packing.pack_blocks(_written_tokens(spark, sf_dir), BLOCK), "blocks")
    return packing.epoch_batches(blocks).select("split", "block_id", "batch_id", "row")


def _examples(spark, sf_dir):
    return instruct.encode_pairs(i.distinct(spark, sf_dir), i.vocabulary(spark, sf_dir))


def _batched(spark, sf_dir):
    examples = written(_examples(spark, sf_dir).select("pair_id", "x", "y", "n"), "examples")
    return instruct.assign_batches(examples, BATCH)


def _framed(df, bpe):
    """What an example says: its first id, the masked text, the scored text, and its last target."""
    masked = F.zip_with("x", F.concat(F.array(F.lit(-1)), "y"), lambda x, y: F.when(y < 0, x))
    scored = F.filter("y", lambda t: t >= 0)
    return [
        F.get("x", F.lit(0)).cast("bigint").alias("first_id"),
        _md5_of(bp.decode(F.filter(masked, lambda t: t.isNotNull()), bpe)).alias("prompt_md5"),
        _md5_of(bp.decode(scored, bpe)).alias("diagram_md5"),
        F.element_at(scored, -1).cast("bigint").alias("last_id"),
    ]


@query
def instruction_encode(spark, sf_dir):
    examples = _examples(spark, sf_dir)
    return examples.select("pair_id", *_framed(examples, i.vocabulary(spark, sf_dir)))


# Longer than any conversation: nothing is cut.
WHOLE = 2**31 - 2


def _chats(spark, sf_dir, max_len=instruct.MAX_LEN):
    return instruct.encode_conversations(
        table(spark, sf_dir, "conversations"), i.vocabulary(spark, sf_dir), max_len
    )


@query
def conversation_encode(spark, sf_dir):
    """Examples of at most ``MAX_LEN`` ids, and what the same conversations say and score when nothing is cut."""
    bpe = i.vocabulary(spark, sf_dir)
    # 511 ids of at most 100 turns hold the first 100 characters of any conversation.
    text = bp.decode(F.col("x"), bpe)
    cut = _chats(spark, sf_dir).select(
        "conv_id",
        (F.col("n") < instruct.MAX_LEN).alias("fits"),
        F.get("x", F.lit(0)).cast("bigint").alias("first_id"),
        F.substring(text, 1, 100).alias("opening"),
    )
    whole = _chats(spark, sf_dir, WHOLE)
    _, asked, replies, _ = _framed(whole, bpe)
    whole = whole.select(F.col("conv_id").alias("_id"), asked.alias("asked_md5"), replies.alias("replies_md5"))
    return cut.join(whole, F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id")


@query
def dynamic_padding(spark, sf_dir):
    padded = instruct.pad_batches(_batched(spark, sf_dir))
    tail = F.slice("x", F.col("n").cast("int") + 1, F.size("x")), F.slice("y", F.col("n").cast("int") + 1, F.size("y"))
    clean = F.forall(tail[0], lambda t: t == bl.PAD) & F.forall(tail[1], lambda t: t == instruct.IGNORE)
    even = (F.size("x") == F.col("max_n")) & (F.size("y") == F.col("max_n"))
    head = padded.withColumn("x", F.slice("x", F.lit(1), F.col("n").cast("int")))
    framed = _framed(head, i.vocabulary(spark, sf_dir))
    return padded.withColumn("padded", clean & even).withColumn(
        "x", F.slice("x", F.lit(1), F.col("n").cast("int"))
    ).select("pair_id", "batch_id", "padded", *framed)


@query
def padding_waste_report(spark, sf_dir):
    return instruct.padding_report(_batched(spark, sf_dir))


@query
def scored_token_share(spark, sf_dir):
    return instruct.loss_share(_examples(spark, sf_dir))


# -- evaluation ------------------------------------------------------------------------------


def _shapes(spark):
    return grammar(spark)["shapes"]


@query
def needle_context(spark, sf_dir):
    used = i.drawn(spark, sf_dir).groupBy("shape").agg(F.count("*").alias("n_pairs"))
    needles = ev.needles(_shapes(spark)).select(
        "shape", "slot", F.col("left").alias("left_char"), F.col("right").alias("right_char")
    )
    return needles.join(used, "shape")


@query
def slot_outcomes(spark, sf_dir):
    return ev.slot_outcomes(i.predicted(spark, sf_dir), _shapes(spark))


def _scores(spark, sf_dir):
    return ev.scored(i.predicted(spark, sf_dir), _shapes(spark))


@query
def slot_metrics(spark, sf_dir):
    return ev.slot_metrics(_scores(spark, sf_dir))


@query
def pool_novel_gap(spark, sf_dir):
    return ev.pool_novel_gap(_scores(spark, sf_dir))


def _axis_scores(spark, sf_dir):
    sets = pairs.axis_sets(i.order_ids(spark, sf_dir), i.kit(spark, sf_dir))
    return ev.scored(ev.corrupt(sets), _shapes(spark))


@query
def axis_costs(spark, sf_dir):
    return ev.axis_costs(_axis_scores(spark, sf_dir))


@query
def shape_accuracy(spark, sf_dir):
    return ev.shape_accuracy(_axis_scores(spark, sf_dir).filter(F.col("axis") == "phrasing"))


@query
def shape_match(spark, sf_dir):
    return ev.shape_match(i.predicted(spark, sf_dir))


@query
def structural_match(spark, sf_dir):
    return diagrams.structure_report(diagrams.structure_scores(i.predicted(spark, sf_dir)), "fault")


@query
def miss_examples(spark, sf_dir):
    return ev.miss_examples(_scores(spark, sf_dir), 100)


@query
def metric_self_check(spark, sf_dir):
    return ev.self_check(i.distinct(spark, sf_dir), _shapes(spark))


@query
def corrupted_outputs(spark, sf_dir):
    return i.predicted(spark, sf_dir).select("pair_id", "fault", "generated")


@query
def stage_audit(spark, sf_dir):
    header = F.when(i.opener_flag(F.col("pair_id")) > 0, "graph TD")
    audit = ev.stage_audit(i.predicted(spark, sf_dir), header)
    return audit.select("pair_id", "fault", "verdict", _md5("sanitised").alias("code_md5"))


@query
def best_checkpoint(spark, sf_dir):
    return runs.best_epoch(i.run_log(spark, sf_dir))


@query
def early_stop_epoch(spark, sf_dir):
    return runs.early_stop(i.run_log(spark, sf_dir))


@query
def epoch_loss_means(spark, sf_dir):
    return runs.loss_means(i.batch_log(spark, sf_dir))


# -- streaming ---------------------------------------------------------------------------------


@query
def stream_pairs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    keys = (
        spark.readStream.schema(orders.schema)
        .parquet(f"{sf_dir}/orders*.parquet")
        .select(F.col("o_orderkey").alias("pair_id"), F.current_timestamp().alias("arrived"))
        # Keys are short and drawing a pair is not: use every core.
        .repartition(spark.sparkContext.defaultParallelism)
    )
    fresh = jobs.stream_pairs(keys, i.kit(spark, sf_dir)).select("prompt", "diagram")
    sink = work_path(spark, "stream-pairs")
    jobs.append_parquet(fresh, sink, work_path(spark, "stream-pairs-state")).awaitTermination()
    return spark.read.schema("prompt string, diagram string").parquet(sink)


@query
def stream_tokenize(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    source = spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/documents*.parquet")
    sink = work_path(spark, "stream-tokens")
    jobs.stream_tokenize(
        source, i.vocabulary(spark, sf_dir), sink, work_path(spark, "stream-tokens-state")
    ).awaitTermination()
    shards = spark.read.schema("doc_id bigint, split string, ids array<int>").parquet(sink)
    return bp.token_conservation(shards, i.vocabulary(spark, sf_dir))


# -- prompt to diagram -----------------------------------------------------------------------------


@query
def synthesize_diagrams(spark, sf_dir):
    kit = i.kit(spark, sf_dir)
    prompts = i.drawn(spark, sf_dir)
    found = synthesize.synthesize(prompts, kit.phrases, _shapes(spark))
    return found.select("pair_id", "shape", i.slot_text(F.col("slots")).alias("slot_text"), "generated")


@query
def unmatched_prompts(spark, sf_dir):
    kit = i.kit(spark, sf_dir)
    as_pair = F.struct(F.concat_ws("-", F.lit("pair"), "pair_id").alias("key"), "prompt")
    # Matched and joined again: drawn once, into a table.
    prompts = written(i.free_prompts(spark, sf_dir, also=[as_pair]), "prompts")
    matched = synthesize.synthesize(prompts, kit.phrases, _shapes(spark), "key")
    return synthesize.unmatched(prompts, matched, "key").select("key", "reason")


def _shortened(pairs_):
    """``key, short`` beside the pairs: prompts without one of their uncapitalised words, drawn by key, that the grammar lacks."""
    keyed = pairs_.withColumn("key", F.concat_ws("-", F.lit("short"), "pair_id"))
    words = F.split("prompt", " ")
    # The places of plain words, each word read once.
    marked = F.transform(words, lambda w, k: F.when(~w.rlike(r"^\p{Lu}"), k))
    drawn = keyed.select("*", words.alias("ws"), F.array_compact(marked).alias("plain"))
    h = draw.digest(9, F.col("key"), "dropped word")
    at = F.get("plain", draw.pick(h, F.greatest(F.size("plain"), F.lit(1))).cast("int"))
    # Drawn once per prompt, outside any lambda over its words.
    drawn = drawn.select(*keyed.columns, "ws", at.alias("at"))
    rest = F.concat(F.slice("ws", F.lit(1), F.col("at")), F.slice("ws", F.col("at") + 2, F.size("ws")))
    kept = F.when(F.col("at").isNull(), F.col("ws")).otherwise(rest)
    return drawn.select(*keyed.columns, F.array_join(kept, " ").alias("short"))


@query
def nearest_phrasings(spark, sf_dir):
    """Prompts no paraphrase explains, with the nearest one within two words."""
    kit = i.kit(spark, sf_dir)
    made = _shortened(i.drawn(spark, sf_dir).select("pair_id", "prompt"))
    prompts = written(i.free_prompts(spark, sf_dir, made, [F.struct("key", F.col("short").alias("prompt"))]), "prompts")
    matched = synthesize.synthesize(prompts, kit.phrases, _shapes(spark), "key")
    left = written(synthesize.unmatched(prompts, matched, "key"), "unmatched")
    near = nearest.nearest_phrasings(left, kit.phrases, _shapes(spark), "key")
    return left.select("key", "reason").join(near, "key", "left")


# -- the kit of cheap words -----------------------------------------------------------------------


def _full_size(f: Query) -> Query:
    def build(spark, sf_dir):
        with i.full_size():
            return f(spark, sf_dir)

    return build


# Queries that use the pools and fragments, with a kit built from what the vocabulary handles cheaply.
# SQL cannot repeat that choice, so these have no twin.
FULL_KIT = (
    "axis_costs axis_sets corrupted_outputs diagram_openers diagram_skeleton generate_pairs label_pools "
    "lexicon_report metric_self_check miss_examples normalize_code novel_slots novel_spans pair_mix_report "
    "pairs_json_roundtrip pool_novel_gap pool_value_split reassemble_output render_pairs sample_slots "
    "sanitize_diagrams shape_accuracy shape_match slot_metrics slot_outcomes split_leakage_audit stage_audit "
    "stream_pairs synthesize_diagrams title_case_warning unmatched_prompts"
).split()
FULL: dict[str, Query] = {f"full_{name}": _full_size(QUERIES[name]) for name in FULL_KIT}

"""Readers and writers: corpora, grammar tables, pairs, token shards, vocabularies."""

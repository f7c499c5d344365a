"""Operators for large text corpora: media shards, crawl records, deduplication, language, toxicity, packing and token files."""

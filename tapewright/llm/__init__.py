"""Operators that prepare training data: quality, WARC, decontamination, chat, PII, BPE, deduplication, toxicity."""

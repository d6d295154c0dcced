"""Training-data operators: filtering, near and exact dedup, decontamination, tokenizing, PII, WARC and extraction.

Nothing else in the library imports this subpackage.
"""

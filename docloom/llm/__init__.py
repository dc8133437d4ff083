"""Training-data operators (PII, tokenisation, packing, chat formatting, deduplication, ...).

Nothing outside this subpackage imports it.
"""

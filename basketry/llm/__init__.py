"""Training-data operators: near-dedup, decontamination, language, URL, mixing, WARC, quality, HTML and PII.

Nothing outside this subpackage imports it.
"""

"""Training-data pipeline operators: URL filters, toxicity, near-dedup,
decontamination, language ID, media columns, packing, secrets, licenses, PII.

Nothing outside this subpackage imports it.
"""

"""Training-data operators (toxicity, decontamination, quality, near-dedup,
token files, token counts, BPE, licences, URL rules, rule ledger).

Nothing outside this package imports it; ``catalog`` registers its queries.
"""

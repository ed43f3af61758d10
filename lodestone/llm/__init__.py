"""Training-data operators: dedup, filtering, scoring and tokenisation of document tables.

Nothing outside this subpackage imports it; ``lodestone.llm.queries`` holds the registered queries.
"""

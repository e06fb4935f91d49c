"""Training-data operators: one module per operator, queries in :mod:`retrospark.llm.queries`."""

"""Text preparation for training corpora.

Each module holds one operator: lookalikes (1), terms (2), overlap (4), noise (5), encode (6),
leaks (7), privacy (8). `queries` has the named queries, `sql` their SQL twins.
Nothing outside this subpackage imports it.
"""

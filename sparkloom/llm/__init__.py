"""Corpus operators for training-data pipelines.

One module an operator, plus ``common`` (scratch tables, row keys), ``textops``
(vectorised byte and word hashing) and ``queries`` (registered queries and
oracles).  Nothing outside this subpackage imports it.
"""

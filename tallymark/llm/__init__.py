"""Training-data operators: deduplication, filtering, mixing, language ID, token output, audits and chat formatting.

Nothing else in the library imports this subpackage.  ``queries.QUERIES`` and
``queries.ORACLE_SQL`` hold the registered queries of the dealt operators.
"""

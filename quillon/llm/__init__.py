"""Training-data operators. Nothing outside this subpackage imports it.

Each module holds one operator with its own general interface; ``queries``
holds the thin ``opN_<name>`` queries that give the contract's columns.
"""

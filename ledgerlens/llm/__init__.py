"""Operators for preparing training corpora at scale.

Nothing else in the library imports this subpackage: it can be deleted together
with ``tests/llm`` and everything else keeps working.
"""

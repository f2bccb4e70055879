"""Operators for preparing language-model training data at corpus scale.

Nothing outside this subpackage imports it; ``daybook.llm.queries`` holds the
registered queries.
"""

"""Training-data operators: each module holds one operator, ``queries`` applies them to whole tables.

Nothing outside this subpackage imports it.
"""

"""Training-data operators: each module holds one operator with its own interface.

Nothing outside this subpackage imports it; ``queries`` registers the thin queries.
"""

"""Training-data operators: independent DataFrame functions and their registered queries.

Nothing outside this subpackage imports it.
"""

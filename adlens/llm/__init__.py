"""Training-data operators: archives, near-duplicates, tokens, scans, mixing, packing, search.

Nothing else in the package imports this subpackage. Each module holds one operator with
a general interface; ``queries`` registers one thin query per operator.
"""

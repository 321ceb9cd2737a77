"""Training-data operators: filters, scores, deduplication, search, mixing, archives and packing.

Nothing outside this subpackage imports it. Every operator is a function from
DataFrame to DataFrame; ``queries`` holds the registered thin queries.
"""

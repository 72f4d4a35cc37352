"""Training-data operators: sampling, fingerprints, packing, filtering, linking and labelling of text tables.

Nothing outside this subpackage imports it; ``queries`` holds the registered queries and their SQL.
"""

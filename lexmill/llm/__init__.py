"""Training-data operators: token files, packing, near-duplicate and quality stages.

Nothing outside this subpackage imports it.
"""

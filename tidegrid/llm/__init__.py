"""Training-data operators: search, archives, token files, packing, deduplication, models.

Each module holds one operator. ``queries`` registers one thin query per
operator; nothing outside this subpackage imports it.
"""

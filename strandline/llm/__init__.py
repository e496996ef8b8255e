"""Training-data operators: deduplication, filtering, decontamination, mixing, formatting, fixity.

Nothing else in the library imports this subpackage; it may be removed as a whole.
"""

"""Byte-level codecs in plain Python and numpy; sources and operators run them inside Arrow batches."""

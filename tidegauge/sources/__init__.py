"""Readers and writers: the datapool, delimited text, archives, cached datasets."""

"""Incremental (fold-at-a-time) result append and resume.

The engine has no event streams; the one incremental surface is the results table, which grows by
committed fold partitions and can be resumed.
"""

"""Operators that prepare text for training language models.

Each module holds one operator with a general interface; ``queries`` applies them to
whole tables and ``oracle`` answers the queries in SQL where SQL can.  Nothing outside
this package imports it.
"""

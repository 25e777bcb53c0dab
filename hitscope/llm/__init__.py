"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage.  Every operator takes a
DataFrame and the names of its id and text columns, reads only those, and so
does not mind further columns of any name.
"""

"""Operators of a training-data pipeline. Nothing outside this subpackage imports it.

Operators keep the columns of their input, with two exceptions: a column named like one they add is
replaced, and names that begin with an underscore are their own, so such input columns are dropped
(only the row id ``_row`` stays where an operator asks for it).
"""

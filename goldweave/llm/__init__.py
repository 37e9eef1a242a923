"""Training-data operators: ten stand-alone operators over text tables.

Nothing else in the library imports this subpackage.  ``queries`` holds the thin
``opN_*`` queries that apply each operator to its whole table.
"""

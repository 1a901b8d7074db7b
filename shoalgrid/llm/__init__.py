"""Training-data operators.

Nothing else in the package imports this subpackage; removing the folder leaves
the rest of the library working.
"""

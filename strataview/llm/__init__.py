"""Training-data operators: ten corpus operators and their contract queries.

Nothing else in the library imports this subpackage; deleting it leaves the
rest of the engine working.
"""

"""Training-data operators: ten text operators over ``documents`` and ``conversations``.

Nothing else in the library imports this subpackage.
"""

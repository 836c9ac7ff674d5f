"""Training-data operators: ten corpus-scale jobs over `documents` and `conversations`.

Nothing else in the library imports this subpackage.
"""

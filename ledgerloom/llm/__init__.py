"""Operations of a large training-data pipeline: ten operators, each usable on its own.

Nothing else in the library imports this subpackage.
"""

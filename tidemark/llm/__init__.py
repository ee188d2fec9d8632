"""Operations of a training-data pipeline over web-scale document tables.

Nothing else in the library imports this subpackage.
"""

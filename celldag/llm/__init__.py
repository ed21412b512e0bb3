"""Operations of a training-data pipeline, each one a Spark job over whole tables.

Nothing else in the library imports this subpackage.
"""

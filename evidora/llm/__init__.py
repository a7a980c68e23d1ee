"""Operations of a training-data pipeline, each a Spark job over whole tables.

Nothing outside this package imports it, so the rest of the library works when
the folder is absent.  Queries are listed in :mod:`evidora.llm.registry`.
"""

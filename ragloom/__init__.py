"""ragloom: document-retrieval analytics as PySpark DataFrame operators.

Entry points: ``ragloom.session.get_spark`` for a session with the library
defaults, ``ragloom.sources.tables.Tables`` for the fixture tables, the
operator modules under ``ragloom.operators`` (chunking, enrich, search,
vector_search, ivf, embed, stats, evaluate, planning, migrate, querylog),
``ragloom.sources`` / ``ragloom.sinks`` / ``ragloom.streaming``, and
``ragloom.registry`` for the checked queries behind ``__spark_entry__``.
"""

__version__ = "0.1.0"

"""revsift: review retrieval and evaluation on Spark.

Operators are plain functions from DataFrames to DataFrames (or Column
expressions), grouped by topic:

* ``revsift.sources.io``       - readers and writers, vector tables, build-or-load
* ``revsift.operators``        - preparation, retrieval, chunking, evaluation,
                                 answers, availability, run logs, scale helpers
* ``revsift.functions``        - column expressions (text, hashing, stemming)
* ``revsift.streaming.jobs``   - the same operators on streaming sources
* ``revsift.plans``            - the registered queries and their SQL twins
"""

__version__ = "0.1.0"

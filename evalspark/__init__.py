"""Spark-native model-evaluation and step-supervision data work.

* ``functions``  column builders (numbers, answers, spans, digests, steps)
* ``sources``    readers, strict JSON, file digests, sinks
* ``operators``  checks, joins, aggregates, statistics, ranks, sampling
* ``plans``      composed jobs (trace ingestion, review gate, merge, studies)
* ``streaming``  incremental result log
"""

"""tracewell: evidence-ledger analytics and data preparation on Spark.

Layout
------
``functions``  Column-level building blocks (blank tests, digests, bands, redaction guard).
``operators``  DataFrame-to-DataFrame operators of the ledger and the general data problems.
``sources``    File inbox, ledger tables and their writers.
``plans``      Distributed primitives that several operators share.
``streaming``  Structured Streaming ingest and late-event merge.
``queries``    The query catalogue with its SQL counterparts.
``llm``        Operators for training-data preparation; nothing else imports it.
"""

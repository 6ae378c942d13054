"""Structured Streaming jobs: page ingest (T1), incremental integration (T2),
status compaction (T3/T4).  Sinks are written per epoch in ``foreachBatch`` so
a replayed micro-batch overwrites its own output instead of duplicating it."""

"""kwspread: keyword-diffusion analytics as Spark DataFrame jobs.

Modules:
  functions/  Column -> Column helpers (text, time, keyword matching)
  sources/    schemas, CSV edge I/O, landed-JSON flattening, dialect adapters
  operators/  DataFrame -> DataFrame operators (diffusion, candidates, comments, pages, presence)
  plans/      adapter views over the driver tables and the registered query catalog
  streaming/  Structured Streaming ingestion (incremental, deduplicated)
"""

from kwspread.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]

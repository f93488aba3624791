"""Structured Streaming forms of ingest (T1), metric windows (T4) and the
notification stream (T6).  Each job checkpoints into the shared folder, so a
restarted job (or a lost executor) resumes exactly where the last committed
micro-batch ended."""

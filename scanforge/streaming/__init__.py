"""Branch monitoring: push verification, branch parsing, rate limiting,
HEAD-change detection and incremental scans (batch and streaming forms)."""

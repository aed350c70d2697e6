"""Report sinks: JSON and SARIF documents, stamped output names."""

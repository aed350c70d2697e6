"""DataFrame -> DataFrame operators of the scanning engines."""

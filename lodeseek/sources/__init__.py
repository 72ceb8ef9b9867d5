"""File scans, table stores and result sinks."""

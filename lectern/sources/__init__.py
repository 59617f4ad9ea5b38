"""Sources and sinks: title lists, directories, documents, SQLite, lookup caches, exports."""

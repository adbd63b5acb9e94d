"""Sources and sinks: test-data adapters, CSV load path, literal tables, checks, sinks."""

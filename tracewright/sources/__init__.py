"""Sources and sinks: log text, label files, and the tables of the library."""

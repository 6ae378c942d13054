"""Sources and sinks: the driver's tables, stand-in views, landed pages, the store."""

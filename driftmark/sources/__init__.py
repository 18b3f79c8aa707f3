"""Sources and sinks: fixture streams, text formats, pane files."""

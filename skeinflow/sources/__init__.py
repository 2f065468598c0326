"""Sources and sinks: snapshots, pasted texts, images, traces and exports."""

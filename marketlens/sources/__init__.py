"""Sources and sinks: normalising raw payloads, keyed upserts, logs, archives and exports."""

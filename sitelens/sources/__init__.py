"""Sources: stored page snapshots, discovery documents, reports, ledger, configuration. No network access."""

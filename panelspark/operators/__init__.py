"""DataFrame-to-DataFrame operators over panels, documents, signals and trial ledgers."""

"""Set-based operators over catalog, snapshots, runs and rules."""

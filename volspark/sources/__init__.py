"""Scans and sinks of dated series, ledgers and manifests."""

"""DataFrame operators over long tables keyed by series (or pair) and date."""

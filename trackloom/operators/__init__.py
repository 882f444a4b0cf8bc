"""DataFrame-to-DataFrame operators, grouped by the table they work on."""

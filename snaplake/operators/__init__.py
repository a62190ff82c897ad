"""DataFrame operators: latest-per-key, merge, landing jobs, load reports."""

"""DataFrame operators: filters, joins, aggregates, windows, sorts, audits, transitions."""

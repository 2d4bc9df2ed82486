"""DataFrame operators: filters, joins, reports, assembly, alerts and evaluation."""

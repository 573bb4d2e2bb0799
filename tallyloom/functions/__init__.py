"""Column builders: filters, measures, and text, date and geo functions."""

"""Analyses built from the operators: warehouse and reports, scripts, firmware, records."""

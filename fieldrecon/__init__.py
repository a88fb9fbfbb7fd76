"""fieldrecon: Spark operators for auditing field-maintenance records."""

"""Accountable record pipelines on Spark: chunked reads, mapping, rules, grouped delivery and a ledger of every record."""

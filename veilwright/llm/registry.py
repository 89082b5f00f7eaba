"""All queries of the corpus operators and the SQL that states their results."""

from veilwright.llm import bpe, chat_format, decontamination, html_extraction, line_dedup, near_dedup, quality_classifier, quality_rules, secret_scan, sharding

MODULES = [bpe, near_dedup, quality_rules, sharding, decontamination, line_dedup, quality_classifier, html_extraction, secret_scan, chat_format]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}

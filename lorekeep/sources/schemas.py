"""Schemas of the canonical tables."""

MESSAGES = "conv_ord long, conv_id string, msg_ord int, id string, role string, content string, timestamp double, is_hidden boolean"
CONVERSATIONS = "conv_ord long, id string, title string, create_time double"
FACTS = "fact_ord long, fact string, category string, source_convo_id string, source_timestamp double, source_quote string"
DEDUPED = "ord long, fact string, category string, period string"
# The categories, in the order in which profiles show them.
CATEGORIES = ["identity", "values", "emotions", "relationships", "growth", "history", "practices", "shadows"]

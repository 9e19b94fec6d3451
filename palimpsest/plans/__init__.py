"""End-to-end plans: session events to records, questions to recall blocks."""

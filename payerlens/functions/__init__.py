"""Column expressions: cleaning, dates, code formats, bands and message text."""

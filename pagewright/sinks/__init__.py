"""Documents as files: text, HTML, word-processor and sheet formats."""

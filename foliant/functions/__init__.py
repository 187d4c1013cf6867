"""Column functions: native expressions over text, Markdown, addresses and metadata."""

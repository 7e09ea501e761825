"""trylens: exception-site analytics for code corpora on Spark."""

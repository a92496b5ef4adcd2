"""Row-local operators on Structured Streaming sources."""

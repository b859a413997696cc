"""Source readers and writers."""

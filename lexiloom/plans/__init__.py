"""Query understanding and end-to-end plans."""

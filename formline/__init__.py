"""formline: point-in-time features and temporal evaluation for logs of two-sided events."""

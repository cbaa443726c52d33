"""The streaming form of the session count."""

"""The same answers as plain SQL, for checking."""

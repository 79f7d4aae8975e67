"""Log-session analytics as DataFrame operators."""

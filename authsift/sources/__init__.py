"""Readers (text logs, logon exports, intel, labels, results), writers, and the
test inputs derived from the driver's tables."""

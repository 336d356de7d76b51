"""The toolkit's operators run over the test tables, and the same results in plain SQL."""

"""Set-at-a-time operators over a registry (DataFrame in, DataFrame out)."""

"""Where the two relations come from."""

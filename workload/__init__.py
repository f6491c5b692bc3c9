"""The registered queries and their SQL checks over the star schema test tables."""

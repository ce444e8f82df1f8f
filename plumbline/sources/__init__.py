"""Reading, generating, caching and writing tables."""

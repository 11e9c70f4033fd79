"""DataFrame operators; each states how it behaves under a hot key."""

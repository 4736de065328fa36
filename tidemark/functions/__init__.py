"""Column functions: dates, masks, hashes, states, guard patterns."""

"""Nothing: every source of this engine is finite, so there is no unbounded input, time or state to stream over."""

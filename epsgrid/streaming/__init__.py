"""Nothing here: every input of the engine is bounded."""

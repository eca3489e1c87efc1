"""Results that leave the engine."""

"""Column helpers and the few multi-step building blocks the operators share."""

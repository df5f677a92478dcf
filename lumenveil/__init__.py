"""Text-privacy analytics on Spark: detection, budgets, perturbation, attacks and metrics as DataFrame transformations."""

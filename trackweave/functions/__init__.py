"""Column functions: geometry, energies, feature calculators."""

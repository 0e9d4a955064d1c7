"""contractflow: keep JSON events in line with a declared contract, on Spark."""

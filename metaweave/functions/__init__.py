"""Column functions of the significance model."""

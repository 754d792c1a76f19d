"""Column expressions: parsing, classification, carbon, geometry."""

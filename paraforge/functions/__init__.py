"""Value conversions and checks as column expressions."""

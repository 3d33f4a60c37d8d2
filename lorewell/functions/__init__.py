"""Part of lorewell."""

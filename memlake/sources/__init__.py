"""Tables, imports and bundles as grains."""

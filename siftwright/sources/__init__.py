"""Tables, case files and model inventories."""

"""Graph operators over symbols and edges."""

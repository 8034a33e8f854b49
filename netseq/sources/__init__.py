"""Reading flow tables and keeping preprocessed ones."""

"""Reading logs and catalogues, shaping their columns, writing results."""

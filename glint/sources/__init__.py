"""Reading tables and files, and the stand-in observation tables."""

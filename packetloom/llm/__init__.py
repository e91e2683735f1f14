"""Training-data operators. Nothing outside this subpackage imports it; drop the folder and the rest works."""

"""logosmill: discourse and argumentation analytics as DataFrame functions."""

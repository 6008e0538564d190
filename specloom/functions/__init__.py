"""Part of specloom."""

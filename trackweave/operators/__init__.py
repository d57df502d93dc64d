"""Relational and graph operators over tracks and their edges."""

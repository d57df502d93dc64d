"""Keeping a library in step with a folder as files arrive."""

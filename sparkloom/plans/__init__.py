"""SQL front door and the registered query library."""

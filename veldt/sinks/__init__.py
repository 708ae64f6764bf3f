"""Reports and result documents."""

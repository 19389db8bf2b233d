"""Where rows come from: versioned tables, their catalog, and run logs."""

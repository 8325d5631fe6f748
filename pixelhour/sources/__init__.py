"""Where rows come from: raw JSON posts, line files, measurement and device tables."""

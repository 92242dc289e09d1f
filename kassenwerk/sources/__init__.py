"""Where rows come from and where they go: tables, CSV, JSON records, report files."""

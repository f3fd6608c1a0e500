"""Where rows come from and go to: tables, change log, snapshots, archives, JSON."""

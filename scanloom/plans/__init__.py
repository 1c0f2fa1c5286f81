"""Plan building blocks: staging, joining of per-group results, query registry."""

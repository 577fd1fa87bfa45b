"""DataFrame-to-DataFrame jobs: frontier, link discovery, pages, tags, feeds."""

"""DataFrame operators over products, pages, frontier, requests and logs."""

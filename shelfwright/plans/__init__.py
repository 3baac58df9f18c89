"""The query catalogue: each query with its SQL counterpart."""

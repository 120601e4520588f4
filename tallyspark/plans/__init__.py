"""Session settings and the skew-safe plan shapes shared by the operators."""

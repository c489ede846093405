"""DataFrame operators of paired-image evaluation."""

"""DataFrame operators: cleaning, sampling, neighbours, profiles, scores."""

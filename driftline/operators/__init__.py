"""DataFrame operators: panels, scores, models, inference."""

"""Column functions: frames, volatility proxies, features, normal distribution."""

"""Analytics for software-supply-chain security data, as Spark jobs."""

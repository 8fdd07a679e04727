"""tessera: DataFrame operators for text, sets, geometry, graphs, time series and models."""

__all__ = ["operators", "sources", "functions", "plans", "streaming"]

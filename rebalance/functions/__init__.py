from rebalance.functions.vectors import distance, euclidean, interpolate, manhattan

__all__ = ["distance", "euclidean", "interpolate", "manhattan"]

from rebalance.plans.balance import balance

__all__ = ["balance"]

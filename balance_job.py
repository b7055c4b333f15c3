"""Entry script for spark-submit; see ``rebalance/plans/job.py``."""

from rebalance.plans.job import main

if __name__ == "__main__":
    main()

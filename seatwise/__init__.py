"""Group-churn analytics on Spark: usage events in, churn features, labels and scores out."""

from seatwise.config import ChurnConfig

__all__ = ["ChurnConfig"]

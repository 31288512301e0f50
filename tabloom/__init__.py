"""tabloom: tabular analytics and AutoML written as Spark DataFrame jobs."""

__version__ = "0.1.0"

"""memspark: set-oriented operators over conversational-memory tables, on Spark."""

__version__ = "0.1.0"

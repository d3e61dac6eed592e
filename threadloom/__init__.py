"""threadloom: coordinated-account analytics on comments, written as Spark DataFrame plans."""

__version__ = "0.1.0"

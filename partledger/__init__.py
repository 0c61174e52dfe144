"""Spark-first analytics over product, component and supplier evidence."""

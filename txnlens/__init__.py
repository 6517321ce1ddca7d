"""A PySpark-native analytics engine for payment-transaction risk."""

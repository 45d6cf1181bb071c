"""faultline: a PySpark-native analytics engine for software-defect lifecycles."""

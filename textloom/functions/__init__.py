"""Column -> Column functions and the few Python UDFs."""
